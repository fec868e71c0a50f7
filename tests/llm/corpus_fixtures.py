"""Texts that the tests share."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and harbour ledger winter marble candle orchard violet engine drift lantern copper meadow signal river stone bridge paper".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "", ",", "."]) for _ in range(n))


#: Null, empty, blank, one word, odd characters, long.
ODD = [None, "", " \n\t ", "word", "Ünï çödé İ Σς", "a\u2028b\u00a0c", "x" * 5000, "tab\tand  double  spaces\r\n", "🙂🙃" * 50, "it's we'll they've I'm 'tis ''s", "<|endoftext|> inside <|startoftext|>"]
