import random
import re
from datetime import UTC, datetime, timedelta, timezone
from decimal import Decimal

from pyspark.sql import functions as F

from rowtide.functions.predicates import is_ddl, printable_one_line, safe_to_quote, valid_raw
from rowtide.functions.values import comment_safe, display, equal_cells, float_text, literal, quote_identifier, unrenderable
from rowtide.model import CELL


def cell(**v):
    tags = {"i": 1, "u": 2, "f": 3, "d": 4, "b": 5, "bin": 7, "t": 8, "raw": 9}
    (name,) = v
    return {f: None for f in CELL.fieldNames()} | {"tag": tags[name], name: v[name]}


def run(spark, rows, kind, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"n int, x {kind}")
    return [r[0] for r in df.orderBy("n").select(expression(F.col("x"))).collect()]


def quoted(raw):
    """The rule for bytes: between quotes where they mean the same under every setting, else in hex."""
    try:
        plain = raw.decode("utf-8")
    except UnicodeDecodeError:
        return "X'" + raw.hex().upper() + "'"
    if any(ord(c) < 32 or c in "\x7f\\" for c in plain):
        return "X'" + raw.hex().upper() + "'"
    return "'" + plain.replace("'", "''") + "'"


def literal_cases():
    rng = random.Random(20)
    cases = [(None, "NULL")]
    cases += [(cell(i=n), str(n)) for n in (0, -1, rng.randrange(1 << 40), -(1 << 63), (1 << 63) - 1)]
    cases += [(cell(u=Decimal(n)), str(n)) for n in (0, 1 << 63, (1 << 64) - 1)]
    cases += [(cell(b=n), str(int(n))) for n in (False, True)]
    cases += [(cell(d=n / 8), str(n // 8) if n % 8 == 0 else str(n / 8)) for n in (-24, -3, 5, 16, 1001)]
    cases += [(cell(raw=t), t) for t in ("007", "-3.250", "+6e-2")]
    alphabet = ["a", "Z", " ", "'", "%", "ß", "漢", "🍐", "\\", "\t", "\r", "\x01", "\x7f", "`"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(6))).encode() for _ in range(40)]
    texts += [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 7))) for _ in range(20)] + [c.encode() for c in alphabet]
    cases += [(cell(bin=t), quoted(t)) for t in texts]
    for minutes in (0, 95, -210):
        moment = datetime(2019, 11, 3, 6, 59, 1, tzinfo=timezone(timedelta(minutes=minutes)))
        for micros in (0, 40, 500_000):
            shown = (moment.astimezone(UTC)).strftime("%Y-%m-%d %H:%M:%S") + (f".{micros:06d}" if micros else "")
            cases.append((cell(t=moment.replace(microsecond=micros)), f"'{shown}'"))
    return cases


def test_literals(spark):
    cases = literal_cases()
    assert run(spark, [c for c, _ in cases], CELL.simpleString(), literal) == [w for _, w in cases]


def test_display_is_the_literal_without_quotes(spark):
    cases = [(c, w) for c, w in literal_cases() if c is None or c["bin"] is None or b"'" not in c["bin"]]
    bare = [None if c is None else w[1:-1] if w.startswith("'") else w for c, w in cases]
    assert run(spark, [c for c, _ in cases], CELL.simpleString(), display) == bare
    assert run(spark, [cell(bin=b"o'clock")], CELL.simpleString(), display) == ["o'clock"]


NUMBER = re.compile(r"[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?")


def numberlike(rng):
    """Texts over the letters of numbers, numbers and near misses alike."""
    texts = {"".join(rng.choices("0179+-.eE", k=rng.randrange(7))) for _ in range(400)}
    texts |= {f"{sign}{whole}{part}{power}" for sign in ("", "+", "-") for whole in ("", "0", "52") for part in ("", ".", ".50") for power in ("", "e", "E3", "e-12", "e+")}
    near = ("{}x", "x{}", "{} ", "{}\n", "\t{}", "({})", "{},1", "{}/**/", "{} and 8", "0b{}", "\u0663{}", "{}\u00a0")
    return sorted(texts | {n.format("52") for n in near})


def test_raw_is_a_number_or_refused(spark):
    texts = numberlike(random.Random(3))
    fine = [bool(NUMBER.fullmatch(t)) for t in texts]
    assert any(fine) and not all(fine)
    assert run(spark, texts, "string", valid_raw) == fine
    assert run(spark, [cell(raw=t) for t in texts], CELL.simpleString(), literal) == [t if ok else None for t, ok in zip(texts, fine, strict=True)]
    assert [x is None for x in run(spark, [cell(raw=t) for t in texts], CELL.simpleString(), unrenderable)] == fine


def test_float_text(spark):
    want = {0.0: "0", 1.0: "1", 123456.0: "123456", 1234567.0: "1.234567e+06", 1e7: "1e+07", 1e21: "1e+21", 0.0001: "0.0001", 0.00001: "1e-05", -2.5: "-2.5", 1e-300: "1e-300", 1.7976931348623157e308: "1.7976931348623157e+308", float("inf"): "+Inf", 2e-323: "2e-323", 5e-324: "5e-324", 2.0**-44: "5.684341886080802e-14"}
    assert run(spark, list(want), "double", lambda x: float_text(x, "double")) == list(want.values())
    assert run(spark, [0.1, 16777216.0, 3.4e38], "float", lambda x: float_text(x, "float")) == ["0.1", "1.6777216e+07", "3.4e+38"]


def test_is_ddl(spark):
    words = ["ALTER", "create", "Drop", "RENAME", "truncate"]
    yes = [lead + w + rest for lead in ("", " ", "\n\t") for w in words for rest in (" x", " TABLE a")]
    no = [w + "ed x" for w in words] + [w for w in words] + ["x " + w + " y" for w in words] + ["/* c */ DROP x", "GRANT ALL", "", " ", None]
    assert run(spark, yes, "string", is_ddl) == [True] * len(yes)
    assert run(spark, no, "string", is_ddl) == [False] * len(no)


def test_quoting_and_printing(spark):
    assert run(spark, ["a`b", ""], "string", quote_identifier) == ["`a``b`", "``"]
    rows = [b"plain text", "ünïcode".encode(), b"a\\b", b"\xff", b"tab\t", "rtl\u202e".encode(), "nbsp\u00a0".encode(), "line\u2028".encode()]
    assert run(spark, rows, "binary", safe_to_quote) == [True, True, False, False, False, True, True, True]
    assert run(spark, rows, "binary", printable_one_line) == [True, True, True, False, False, False, False, False]


def test_comments_are_cut_at_characters(spark):
    rows = [b"x" * 200, b"x" * 201, b"x" * 199 + "é".encode() + b"y", b"a\nb", b"\xff", ("é" * 101).encode()]
    want = ["x" * 200, "x" * 200 + "… <truncated, 201 bytes total>", "x" * 199 + "… <truncated, 202 bytes total>", "<unprintable, 3 bytes>", "<unprintable, 1 byte>", "é" * 100 + "… <truncated, 202 bytes total>"]
    assert run(spark, rows, "binary", comment_safe) == want


def test_equality_knows_types_and_nan(spark):
    pairs = [(cell(i=1), cell(i=1), True), (cell(i=1), cell(raw="1"), False), (None, None, True), (None, cell(i=0), False), (cell(d=float("nan")), cell(d=float("nan")), False), (cell(bin=b"a"), cell(bin=b"a") | {"tag": 6}, False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], f"n int, a {CELL.simpleString()}, b {CELL.simpleString()}")
    assert [r[0] for r in df.orderBy("n").select(equal_cells(F.col("a"), F.col("b"))).collect()] == [w for *_, w in pairs]
