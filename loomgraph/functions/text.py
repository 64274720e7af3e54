"""Text matching by normalised phrases and informative terms, and token estimates."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.fixed import STOP_WORDS


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """Compatibility forms below the astral planes: characters that have a single one, theirs, and those of several characters."""
    form = {c: n for k in range(0x80, 0xFFFF) if not 0xD800 <= k < 0xE000 and (n := unicodedata.normalize("NFKC", c := chr(k))) != c}
    single = {c: n for c, n in form.items() if len(n) == 1}
    return "".join(single), "".join(single.values()), {c: n for c, n in form.items() if len(n) > 1}


def compatible(text: Column) -> Column:
    """NFKC of each character on its own: wide, narrow and circled forms, ligatures, fractions, units; marks aren't composed.

    Texts without letters beyond ASCII aren't looked at, and only those with a character that becomes several are split.
    """
    from_, to, several = _folds()
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    widened = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(table[c], c)), "")
    folded = F.translate(text, from_, to)
    # a table of characters, where a class of so many would try one after the other
    some = F.char_length(F.translate(text, "".join(several), "")) < F.char_length(text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.when(some, widened(folded)).otherwise(folded)).otherwise(text)


def normalized(text: Column) -> Column:
    """Compatibility forms folded, lower case, ``_`` and ``-`` as spaces, letters and digits alone, single spaces."""
    out = F.regexp_replace(F.lower(compatible(F.coalesce(text, F.lit("")))), "[_-]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def terms(norm: Column) -> Column:
    """Distinct informative tokens of normalised text; all its tokens if none is informative."""
    raw = F.filter(F.split(norm, " "), lambda t: t != "")
    good = F.filter(raw, lambda t: t.rlike(r"[^\x00-\x7F]") | ((F.char_length(t) >= 2) & ~t.isin(*STOP_WORDS)))
    return F.array_distinct(F.when(F.size(good) > 0, good).otherwise(raw))


def required(n: Column) -> Column:
    """How many of ``n`` query terms must be found."""
    return F.when(n <= 2, n).otherwise(F.greatest(F.lit(2), F.ceil(n * 0.6).cast("int")))


def matched(target: Column, query_terms: Column) -> Column:
    """How many terms the normalised target contains."""
    return F.size(F.filter(query_terms, lambda t: F.contains(target, t)))


def passes(target: Column, query: Column, query_terms: Column) -> Column:
    """The text filter on normalised text: an empty query, its whole phrase, or enough of its terms."""
    n = F.size(query_terms)
    return (query == "") | F.contains(target, query) | ((n > 0) & (matched(target, query_terms) >= required(n)))


def score(target: Column, query: Column, query_terms: Column, phrase: float, term: float, coverage: float, full: float) -> Column:
    """The match score on normalised text."""
    def sum_(m: Column) -> Column:
        n = F.size(query_terms)
        total = F.when(F.contains(target, query), phrase).otherwise(0.0) + m * term
        return total + F.when(n > 0, m / n * coverage).otherwise(0.0) + F.when((n > 0) & (m == n), full).otherwise(0.0)

    return F.when(query == "", 0.0).otherwise(let(matched(target, query_terms), sum_))


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.char_length(text) / 4).cast("int"))


def preview(text: Column, size: int = 96) -> Column:
    """White space collapsed, and cut with an ellipsis beyond ``size``."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(flat) <= size, flat).otherwise(F.concat(F.substring(flat, 1, size - 3), F.lit("...")))
