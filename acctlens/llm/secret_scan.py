"""Secret scan with DataFrame functions only.

Base kinds are regular expressions, matched leftmost and without overlap: ``assign`` (a secret's
name, a separator and a value of 6 or more characters), ``access`` and ``hex``.  The method adds
``entropy`` spans: candidate strings (runs of 20 or more token characters) in which some window of
``WINDOW`` characters has a Shannon entropy above its character class's threshold.  The window
slides by one character: the count of the entering character grows, that of the leaving one
shrinks, and the sum of c*log2(c) follows from these two counts alone.  Classes: ``hex`` candidates (lower or upper case, at least one
digit and one letter) and ``base64`` candidates (digits, upper and lower case all present).  Within
any candidate a single window counts by its own class too: ``hex``, or ``base36``, digits with letters of one case.
Candidates are cut at assign, access and hex spans already reported and at placeholder words; each
piece of 20 or more characters is tested by itself.  UUIDs are known not to be secrets.

Spans are code points, end exclusive.  A match's place follows from the pieces between matches
(``split``) and the matches (``regexp_extract_all``), both of one pattern.

Null and empty texts have no spans.  Repeated rows and ids give a row each; an empty table gives
none.  Columns other than those named are ignored; ``redact`` keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
ACCESS_CHARS, HEX_CHARS, VALUE_CHARS = 20, 24, 6

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
THRESHOLDS = {"hex": 3.0, "base64": 3.7, "base36": 3.5}               # bits a character, of log2(20) = 4.32 at most
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
PLACEHOLDERS = ("example", "placeholder", "changeme", "your", "dummy", "sample", "xxxx", "0000000", "1234567", "abcdefg")
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"

_SPAN = "array<struct<start:int,kind:int,end:int>>"


CHUNK = 256


def _folded(items: Column, of: str, after, made) -> Column:
    """Go over ``items`` with a running place: ``after(place, x)`` is the next place, ``made(place, x)``
    the array of type ``of`` that x adds.  Arrays grow within chunks of ``CHUNK`` items only, so the
    work grows with the items, not with their square."""
    none = F.array().cast(of)

    def run(all_items):
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(all_items) / CHUNK).cast("int")),
                             lambda c: F.slice(all_items, c * CHUNK + 1, F.lit(CHUNK)))
        starts = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, c: F.struct(
            F.aggregate(c, acc["at"], after).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(chunks, starts, lambda c, p: F.aggregate(
            c, F.struct(p.alias("at"), none.alias("out")),
            lambda acc, x: F.struct(after(acc["at"], x).alias("at"), F.concat(acc["out"], made(acc["at"], x)).alias("out")), lambda acc: acc["out"])))

    # the items are computed once, as the element of an outer array
    return F.get(F.transform(F.array(items), run), F.lit(0))


def _located(text: Column, pattern: str) -> Column:
    """array of (at, s): where each match of ``pattern`` starts, and the match."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # the piece after the last match has no match behind it
    both = F.zip_with(F.slice(F.transform(pieces, F.char_length), 1, F.size(matches)), matches, lambda n, s: F.struct(n.alias("n"), s.alias("s")))
    kind = "array<struct<at:int,s:string>>"
    found = _folded(both, kind, lambda at, x: at + x["n"] + F.char_length(x["s"]),
                    lambda at, x: F.array(F.struct((at + x["n"]).alias("at"), x["s"].alias("s"))))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(kind))


def _replaced(text: Column, spans: Column, mark) -> Column:
    """``text`` with ``spans`` (sorted by start) replaced by ``mark(x)``; x has the ``start`` and ``end``
    of what no earlier span covers and ``fresh``, whether the span begins behind all earlier ones."""
    places = _folded(spans, "array<struct<from:int,start:int,end:int,fresh:boolean>>", lambda at, x: F.greatest(at, x["end"]), lambda at, x: F.array(
        F.struct(at.alias("from"), F.greatest(at, x["start"]).alias("start"), F.greatest(at, x["end"]).alias("end"), (x["start"] >= at).alias("fresh"))))

    def chunk(c):
        # a chunk's characters are cut out of the text once, those before a span out of the chunk's
        base = F.get(c, F.lit(0))["from"]
        part = F.substring(text, base + 1, F.element_at(c, -1)["start"] - base)
        return F.get(F.transform(F.array(part), lambda t: F.array_join(F.transform(c, lambda x: F.concat(
            F.substring(t, x["from"] - base + 1, x["start"] - x["from"]), mark(x))), "")), F.lit(0))

    def run(xs):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda c: F.slice(xs, c * CHUNK + 1, F.lit(CHUNK)))
        return F.concat(F.array_join(F.transform(chunks, chunk), ""), F.substring(text, F.element_at(xs, -1)["end"] + 1, F.char_length(text)))

    return F.when(F.size(spans) > 0, F.get(F.transform(F.array(places), run), F.lit(0))).otherwise(text)


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["at"].alias("start"), F.lit(kind).alias("kind"), (m["at"] + F.char_length(m["s"])).cast("int").alias("end")))


def max_window_entropy(s: Column, window: int = WINDOW, above=None) -> Column:
    """The largest Shannon entropy (bits a character) of any ``window`` characters of ``s``, by
    incremental counts; 0 for shorter strings.  ``above``: a window's threshold from its counts by
    symbol; the largest excess over it is returned then, -window for shorter strings."""
    none = 0.0 if above is None else -float(window)
    chars = F.transform(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(SYMBOLS), c))
    weight = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))
    bump = lambda counts, sym, by: F.transform(counts, lambda n, i: F.when(i == sym, n + by).otherwise(n))
    start = F.struct(F.array_repeat(F.lit(0), len(SYMBOLS) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(none).alias("best"))

    def step(acc, x):
        gone = F.when(x["out"].isNull(), acc["counts"]).otherwise(bump(acc["counts"], x["out"], -1))
        was = F.get(acc["counts"], x["out"])
        less = F.when(x["out"].isNull(), F.lit(0.0)).otherwise(weight(was) - weight(was - 1))
        now = F.get(gone, x["in"])
        total = acc["sum"] - less + weight(now + 1) - weight(now)
        full = F.lit(float(window))
        counts = bump(gone, x["in"], 1)
        entropy = F.log2(full) - total / full - (F.lit(0.0) if above is None else above(counts))
        entropy = F.when(x["i"] >= window - 1, entropy).otherwise(F.lit(none))
        return F.struct(counts.alias("counts"), total.alias("sum"), F.greatest(acc["best"], entropy).alias("best"))

    def moves(cs):
        return F.transform(cs, lambda c, i: F.struct(c.alias("in"), F.get(cs, i - window).alias("out"), i.alias("i")))

    # the characters are computed once, as the element of an outer array
    return F.get(F.transform(F.array(chars), lambda cs: F.aggregate(moves(cs), start, step, lambda acc: acc["best"])), F.lit(0))


def _window_threshold(counts: Column) -> Column:
    """The threshold of a window's class, by its counts of ``SYMBOLS`` (from place 1 on)."""
    held = lambda a, z: F.aggregate(F.slice(counts, SYMBOLS.index(a) + 2, SYMBOLS.index(z) - SYMBOLS.index(a) + 1), F.lit(0), lambda x, n: x + n)
    digits = held("0", "9")
    made_of = lambda a, z: (digits > 0) & (digits < WINDOW) & (digits + held(a, z) == WINDOW)
    return (F.when(made_of("a", "f") | made_of("A", "F"), THRESHOLDS["hex"]).when(made_of("a", "z") | made_of("A", "Z"), THRESHOLDS["base36"])
            .otherwise(float(WINDOW)))


def _random_like(s: Column) -> Column:
    is_hex = s.rlike(r"^[0-9a-f]+$|^[0-9A-F]+$") & s.rlike("[0-9]") & s.rlike("[A-Fa-f]")
    is_base64 = s.rlike("[0-9]") & s.rlike("[a-z]") & s.rlike("[A-Z]")
    one_case = s.rlike("[0-9]") & s.rlike("[a-z0-9]{%d}|[A-Z0-9]{%d}" % (WINDOW, WINDOW))
    return (F.when(s.rlike(f"^{UUID}$"), F.lit(False)).when(is_hex & (max_window_entropy(s) >= THRESHOLDS["hex"]), F.lit(True))
            .when(is_base64 & (max_window_entropy(s) >= THRESHOLDS["base64"]), F.lit(True))
            .when(one_case, max_window_entropy(s, above=_window_threshold) >= 0).otherwise(F.lit(False)))


def _pieces(m: Column) -> Column:
    """(at, s) of the pieces of a candidate between its placeholder words."""
    clean = m["s"]
    for word in PLACEHOLDERS:
        clean = F.regexp_replace(clean, f"(?i){word}", " " * len(word))
    cut = F.transform(_located(clean, CANDIDATE), lambda x: F.struct((m["at"] + x["at"]).alias("at"), x["s"].alias("s")))
    return F.when(F.lower(m["s"]).rlike("|".join(PLACEHOLDERS)), cut).otherwise(F.array(F.struct(m["at"].alias("at"), m["s"].alias("s"))))


def with_spans(df: DataFrame, text_col: str, base: str, every: str) -> DataFrame:
    """``df`` with the base spans and all spans as arrays of (start, kind, end), by start, then kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    value = lambda m: F.regexp_extract(m["s"], "^(?:" + ASSIGN + ")$", 2)
    # runs of the access and hex patterns are maximal, so the length may go into the pattern
    assign = _spans(F.filter(_located(text, ASSIGN), lambda m: F.char_length(value(m)) >= VALUE_CHARS), 0)
    access = _spans(_located(text, ACCESS[:-1] + "{%d,}" % (ACCESS_CHARS - 4)), 1)
    hexes = _spans(_located(text, HEX[:-1] + "{%d,}" % HEX_CHARS), 2)
    df = df.withColumn(base, F.array_sort(F.concat(assign, access, hexes)))
    blanked = _replaced(text, F.col(f"`{base}`"), lambda x: F.repeat(F.lit(" "), x["end"] - x["start"]))
    runs = _located(blanked, CANDIDATE)
    entropy = _spans(F.filter(F.flatten(F.transform(runs, _pieces)), lambda m: _random_like(m["s"])), 3)
    return df.withColumn(every, F.array_sort(F.concat(F.col(f"`{base}`"), entropy)).cast(_SPAN))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_spans, spans (joined strings)."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = with_spans(rows, "text", "base", "every")
    count = lambda k: F.size(F.filter("every", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(4)), _joined(F.col("base")).alias("base_spans"), _joined(F.col("every")).alias("spans"))


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", chars_col: str | None = None) -> DataFrame:
    """``df`` with every span of its texts replaced by ``mark`` (overlapping spans by one); rows
    without spans stay as they are.  ``chars_col``: a column to hold the new number of characters."""
    names = _fresh(df.columns, 2)
    found = with_spans(df, text_col, *names)
    spans, text = F.col(names[1]), F.col(f"`{text_col}`")
    clean = _replaced(text, spans, lambda x: F.when(x["fresh"], F.lit(mark)).otherwise(F.lit("")))
    out = found.withColumn(text_col, clean)
    if chars_col and chars_col in df.columns:
        out = out.withColumn(chars_col, F.when(F.size(spans) > 0, F.char_length(F.col(f"`{text_col}`")).cast(df.schema[chars_col].dataType))
                             .otherwise(F.col(f"`{chars_col}`")))
    return out.drop(*names)


def _fresh(columns: list[str], n: int) -> list[str]:
    taken, out, i = {c.lower() for c in columns}, [], 0
    while len(out) < n:
        if (name := f"__spans_{i}") not in taken:
            out.append(name)
        i += 1
    return out
