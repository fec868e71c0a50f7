"""License scan by canonical digests.

A text is brought to a canonical form (lower-cased, copyright lines dropped, punctuation
and white space run together, words of equivalent spelling unified) and the SHA-256 of that
form is hash-joined to the digests of known licences.  The whole text is looked up, whatever
its length and line breaks, and so is each of its lines, which finds notices inside other
prose.

A copyright line names a year or bears a sign: "Copyright (c) ...", "Copyright 2020 ...",
"(c) 2020 ...", "© ...", or is "All rights reserved."; a line that merely begins with the
word is part of a wrapped licence.

The registry is broadcast only after its size is checked; a larger one is joined by a
shuffle of digests.

Defined cases: a null or empty text, and one that the canonical form leaves empty, matches
nothing; a text known under several ids gives the least; repeated lines count each time;
repeated rows and ids are scanned one by one; an empty table gives an empty result; extra
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, flagged, marks, text_or_empty

#: Digests of 64 bytes and an id each: at most some 10 MB are broadcast.
BROADCAST_LICENSES = 100_000
#: Short hashes that may stand in the expression which sifts lines.
LITERALS = 1_000
# Words that count as the same.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisation", "capitalization"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "wilfull"),
)
COPYRIGHT = r"(?m)^[ \t]*(?:(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4})|\(c\)[ \t]*(?:copyright|[0-9]{4})|©)[^\n]*|all rights reserved[.]?[ \t]*)$"

# Known texts.
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.\n\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.\n\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
KNOWN = (
    ("MIT", _GRANT),
    ("MIT", "MIT License\n\n" + _GRANT),
    ("MIT", "The MIT License (MIT)\n\n" + _GRANT),
    ("ISC", _ISC + "\n\n" + _ISC_END),
    ("0BSD", _ISC.partition(", provided")[0] + ".\n\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_THIRD + _BSD_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
)


# Digest of the canonical form and 64-bit hash of longer known texts.
KNOWN_DIGESTS = (
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184", -6022570284285727062),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702", 6574304618045307956),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", -7112245342822382619),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71", 550740613548724496),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6", -2506061327557055004),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", -5912585373762650979),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", -743817596411449132),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68", -7658725519083296699),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", -2733753298109648805),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", -716050838640999502),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", -5375999493702148519),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1", 5075578566110125967),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a", -5894740807586226220),
)


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line feeds kept, so that each line is in it too.

    Two spaces part the words here: then each has its own on either side, and whole words
    can be replaced without a pattern.
    """
    plain = F.regexp_replace(F.lower(text), COPYRIGHT, " ")
    # Typographic quotes, dashes and signs count as punctuation; other letters stay.
    plain = F.regexp_replace(plain, r"[\x00-\x09\x0b-/:-@\[-`{-\x7f\xa0\xa9‐-―‘-‟…]+", "  ")
    plain = F.concat(F.lit(" "), F.replace(plain, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    return reduce(lambda x, pair: F.replace(x, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), SPELLINGS, plain)


def one_line(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


def canonical(text: Column) -> Column:
    """The form whose digest is looked up."""
    return one_line(canonical_lines(text))


def registry(spark: SparkSession, known: tuple = KNOWN, digests: tuple = KNOWN_DIGESTS) -> DataFrame:
    """(digest, license, short): the least id of each digest; short is a 64-bit hash."""
    rows = spark.createDataFrame(list(known), "license string, text string").select("license", canonical(F.col("text")).alias("form"))
    rows = rows.select("license", F.sha2("form", 256).alias("digest"), F.xxhash64("form").alias("short"))
    rows = rows.unionByName(spark.createDataFrame(list(digests), "license string, digest string, short long"))
    return rows.groupBy("digest", "short").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, digest, license (of the whole text), n_notices,
    notices (ids that whole lines match, sorted).

    Texts are brought to form once.  A short hash of each line, looked up among those of
    the registry, keeps lines that match nothing from leaving the scan; the digest join
    decides.  A registry of more than ``LITERALS`` entries is looked up through a bitmap
    instead, for which texts are brought to form a second time.
    """
    # The digest of the empty form is no licence.
    licenses = cut(licenses.where(F.col("digest") != F.sha2(F.lit(""), 256)))
    n_known = licenses.limit(BROADCAST_LICENSES + 1).count()
    shorts = licenses.select("short").distinct()
    few = n_known <= LITERALS
    known = [r["short"] for r in shorts.collect()] if few else []
    found = None if few else marks(shorts, "short")
    licenses = licenses.drop("short")
    licenses = F.broadcast(licenses) if n_known <= BROADCAST_LICENSES else licenses
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), canonical_lines(text).alias("lines"))

    def several(keep) -> Column:
        parts = F.filter(F.transform(F.split("lines", "\n"), one_line), keep)
        return F.when(F.size(F.split("lines", "\n", 2)) > 1, parts).otherwise(F.array().cast("array<string>"))

    digest = F.sha2(one_line(F.col("lines")), 256).alias("digest")
    if few:
        scanned = cut(rows.select("doc_id", "h", digest, several(lambda line: F.xxhash64(line).isin(known)).alias("lines")))
        # Rows that repeat id and text hold the same lines.
        lines = scanned.where(F.size("lines") > 0).dropDuplicates(["doc_id", "h"]).select("doc_id", "h", F.explode("lines").alias("line"))
    else:
        scanned = cut(rows.select("doc_id", "h", digest))
        lines = rows.select("doc_id", "h", F.posexplode(several(lambda line: F.length(line) > 0)).alias("at", "line"))
        lines = flagged(lines, found, F.xxhash64(F.xxhash64("line")), "met").where("met").dropDuplicates(["doc_id", "h", "at"])
    hits = lines.select("doc_id", "h", F.sha2("line", 256).alias("digest")).join(licenses, "digest")
    notices = hits.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(
        F.count(F.lit(1)).alias("n_notices"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices")
    )
    whole = scanned.select("doc_id", "h", "digest").join(licenses, "digest", "left")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))
    return whole.join(notices, same, "left").select(
        "doc_id", "digest", "license", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices")
    )


def oracle(known: tuple = KNOWN, digests: tuple = KNOWN_DIGESTS) -> str:
    """DuckDB SQL for ``scan`` over ``documents``: word by word through a map of spellings."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    spelling = f"MAP {{{', '.join(f'{quote(a)}: {quote(b)}' for a, b in SPELLINGS)}}}"

    def form(x: str) -> str:
        x = f"regexp_replace(lower({x}), {quote(COPYRIGHT)}, ' ', 'g')"
        x = rf"trim(regexp_replace({x}, '[\x00-/:-@\[-`{{-\x7f\x{{a0}}\x{{a9}}\x{{2010}}-\x{{2015}}\x{{2018}}-\x{{201f}}\x{{2026}}]+', ' ', 'g'))"
        return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: coalesce({spelling}[w], w)), ' ')"

    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in known)
    more = ", ".join(f"({quote(i)}, {quote(d)})" for i, d, _ in digests)
    return f"""WITH k AS (SELECT digest, min(id) AS license FROM
  (SELECT id, sha256({form('body')}) AS digest FROM (VALUES {values}) v(id, body) UNION ALL SELECT * FROM (VALUES {more}) w(id, digest)) GROUP BY 1),
d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT n, doc_id, sha256({form('body')}) AS digest FROM d),
li AS (SELECT n, unnest(string_split(body, chr(10))) AS body FROM d WHERE strpos(body, chr(10)) > 0),
hit AS (SELECT n, license FROM (SELECT n, sha256({form('body')}) AS digest FROM li) x JOIN k USING (digest)),
g AS (SELECT n, count(*) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM hit GROUP BY n)
SELECT doc_id, digest, license, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM w LEFT JOIN k USING (digest) LEFT JOIN g USING (n)"""
