"""Secret scans with DataFrame functions alone: fixed forms, and strings of high entropy.

A fixed form is found by its expression; where it lies follows from the lengths of the pieces between its matches.
Candidate strings of mixed letters and digits are judged by the Shannon entropy of a sliding window: one character
enters and one leaves from place to place, and the sum of c*log2(c) over the window's counts is mended for these two
only.  The bound depends on the string's character class.  Strings on the allow list, and strings that overlap a fixed
form, aren't added.

Texts and candidates may be of any length: no expression here backtracks into a repeated group, running sums and
overlaps go by blocks, and a place in a text is looked for in a short piece of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The forms, and lengths that a match must have.  For runs of one class the least length can stand in the
#: expression: a run shorter than that has no part that is as long.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Parameters of the entropy scan: candidates, the window, bounds in bits by class, and what is allowed.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Characters of a candidate that are turned to codes at once.
CODES = 1 << 15
#: Entries of a block of spans, and characters of a piece of text.
BLOCK, PIECE = 256, 1 << 12
BITS = {"hex": 3.0, "alnum": 3.7, "base64": 3.8}
ALLOWED = r"^(?:[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|(?i:.*(?:example|placeholder|sample|dummy|xxxx).*)|[0-9_/=+-]+|(?:[A-Za-z]++[-_/])++[A-Za-z]*[0-9]{0,4})$"

SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _blocks(values: Column) -> Column:
    """An array in slices of BLOCK; one empty slice of an empty one."""
    numbers = lambda v: F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")))
    return _let(values, lambda v: F.transform(numbers(v), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK))))


def _running(values: Column, combine) -> Column:
    """For each of ``values`` what ``combine`` makes of those before it, from 0: within blocks, then across them."""
    none = F.array().cast("array<int>")
    state = F.struct(F.lit(0).alias("at"), none.alias("out"))
    step = lambda s, x: F.struct(combine(s["at"], x).cast("int").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))

    def across(local: Column) -> Column:
        before = F.aggregate(local, state, lambda s, b: step(s, b["at"]))["out"]
        return F.flatten(F.zip_with(local, before, lambda b, at: F.transform(b["out"], lambda x: combine(x, at).cast("int"))))

    return _let(F.transform(_blocks(values), lambda b: F.aggregate(b, state, step)), across)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named, also within a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _located(text: Column, form: str, kind: int, held: str | None = None) -> Column:
    """Matches of ``form`` in ``text``, from the left and apart, as spans in code points; ``held`` is what a match must contain."""
    gaps, hits = F.transform(F.split(text, form, -1), lambda g: F.char_length(g)), F.regexp_extract_all(text, F.lit(form), F.lit(0))
    none = F.array().cast(f"array<{SPAN}>")

    def spans(pairs: Column) -> Column:
        before = _running(F.transform(pairs, lambda p: p["gap"] + F.char_length(p["hit"])), lambda a, b: a + b)

        def span(p: Column, at: Column) -> Column:
            start = at + p["gap"]
            return F.struct(start.cast("int").alias("start"), F.lit(kind).cast("int").alias("kind"), (start + F.char_length(p["hit"])).cast("int").alias("end"), p["hit"].alias("value"))

        return F.zip_with(pairs, before, span)

    # one gap more than matches: the last has no match beside it
    pairs = _let(hits, lambda hs: F.zip_with(F.slice(gaps, F.lit(1), F.size(hs)), hs, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))))
    found = _let(pairs, spans)
    if held:
        found = F.filter(found, lambda x: F.regexp_extract(x["value"], "(?s)^(?:" + held + ")$", 2).rlike(rf"^(?s:.{{{ASSIGN_LEAST},}})$"))
    return F.when(text.rlike(form), found).otherwise(none)


#: c*log2(c) for the counts of a window, in units of 2^-40, so that sums are whole numbers and don't drift.
UNIT = 1 << 40
_WEIGHTS = [0, *(round(c * math.log2(c) * UNIT) for c in range(1, WINDOW + 1))]


def peak_entropy(value: Column, enough: Column | None = None) -> Column:
    """The largest entropy in bits of any WINDOW characters in a row of ``value`` (ASCII); null if it is shorter.

    With ``enough`` the search ends at the first window that reaches so many bits.
    """
    weights = F.lit(_WEIGHTS)
    of_sum = lambda low: F.log2(F.lit(float(WINDOW))) - low / float(UNIT * WINDOW)
    unknown = F.lit((1 << 62)).cast("long")
    done = lambda low: F.lit(False) if enough is None else F.round(of_sum(low), 9) >= enough

    def lowest(codes: Column, low: Column) -> Column:
        count = lambda i, c: F.size(F.filter(F.slice(codes, F.greatest(i - WINDOW, F.lit(1)), F.least(i - 1, F.lit(WINDOW))), lambda x: x == c))

        def step(s: Column, i: Column) -> Column:
            def moved(new: Column) -> Column:
                a = count(i, new)
                enters = lambda a: weights[a + 1] - weights[a]
                leaves = lambda b: weights[b - 1] - weights[b]
                old = codes[i - WINDOW - 1]
                return F.when(i <= WINDOW, s["sum"] + _let(a, enters)).when(old == new, s["sum"]).otherwise(s["sum"] + _let(a, enters) + _let(count(i, old), leaves))

            total = _let(_let(codes[i - 1], moved), lambda t: F.struct(t.alias("sum"), F.when(i >= WINDOW, F.least(s["low"], t)).otherwise(s["low"]).alias("low")))
            return F.when(done(s["low"]), s).otherwise(total)

        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), F.struct(F.lit(0).cast("long").alias("sum"), low.alias("low")), step)["low"]

    def part(low: Column, k: Column) -> Column:
        piece = F.substring(value, k * CODES + 1, F.lit(CODES + WINDOW - 1))
        codes = F.transform(F.split(piece, ""), lambda c: F.ascii(c))
        return F.when(done(low), low).otherwise(_let(codes, lambda c: lowest(c, low)))

    parts = F.sequence(F.lit(0), F.floor((F.char_length(value) - WINDOW) / CODES).cast("int"))
    return F.when(F.char_length(value) >= WINDOW, of_sum(F.aggregate(parts, unknown, part)))


def _of_high_entropy(value: Column) -> Column:
    bits = F.when(value.rlike("^[0-9a-f-]+$") | value.rlike("^[0-9A-F-]+$"), F.lit(BITS["hex"])).when(value.rlike("^[A-Za-z0-9]+$"), F.lit(BITS["alnum"])).otherwise(F.lit(BITS["base64"]))
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(ALLOWED)
    return F.when(mixed, _let(bits, lambda b: F.round(peak_entropy(value, b), 9) >= b)).otherwise(F.lit(False))


def _apart(span: Column, blocks: Column) -> Column:
    """Whether ``span`` overlaps none of the spans in ``blocks`` (structs of a range and its spans)."""
    meets = lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"])
    return ~F.exists(blocks, lambda b: F.when(meets(b), F.exists(b["spans"], meets)).otherwise(F.lit(False)))


def _spans(documents: DataFrame) -> DataFrame:
    """``row`` (all columns of ``documents``), ``base`` and ``spans`` (structs of SPAN, ordered by start, then kind)."""
    rows = documents.select(F.struct("*").alias("row"), F.coalesce(documents["text"].cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    base = F.array_sort(F.concat(_located(text, ASSIGN, 0, ASSIGN), _located(text, ACCESS, 1), _located(text, HEX, 2)))
    rows = rows.select("row", base.alias("base"), _located(text, CANDIDATE, 3).alias("candidates"))
    ranges = F.transform(_blocks(F.col("base")), lambda b: F.struct(F.get(b, F.lit(0))["start"].alias("start"), F.array_max(F.transform(b, lambda x: x["end"])).alias("end"), b.alias("spans")))
    added = _let(ranges, lambda r: F.filter("candidates", lambda c: F.when(_of_high_entropy(c["value"]), _apart(c, r)).otherwise(F.lit(False))))
    return rows.select("row", "base", F.when(F.size("candidates") > 0, F.array_sort(F.concat("base", added))).otherwise(F.col("base")).alias("spans"))


def _written(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")


def scan(documents: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for each row; ``spans`` also has those of kind ``entropy``.

    Null and empty texts have no spans and the digest of nothing.  Repeated rows are scanned each for itself; a null
    ``doc_id`` is kept; other columns are ignored; an empty table gives an empty result.
    """
    rows = _spans(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select("row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))


def redact(documents: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``documents`` with every span of ``text`` replaced by ``mark``; other texts stay as they are, null texts null.

    Spans of different kinds that overlap get one mark.  Repeated rows are masked each for itself; other columns stay
    and may have any names; an empty table gives an empty one.
    """
    text = F.col("row")["text"].cast("string")

    def between(pieces: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        around = F.slice(pieces, first + 1, F.floor(b / PIECE).cast("int") - first + 1)
        return F.substring(F.array_join(around, ""), a - first * PIECE + 1, b - a)

    def masked(pieces: Column) -> Column:
        # what is already out isn't written again
        before = _running(F.transform("spans", lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        out = F.zip_with("spans", before, lambda s, at: F.when(s["start"] >= at, F.concat(between(pieces, at, s["start"]), F.lit(mark))).otherwise(F.lit("")))
        end = F.array_max(F.transform("spans", lambda s: s["end"]))
        return F.concat(F.array_join(out, ""), between(pieces, end, F.char_length(text)))

    new = F.when(F.size("spans") > 0, _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), masked)).otherwise(text)
    kept = [new.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in documents.columns]
    return _spans(documents).select(*kept)
