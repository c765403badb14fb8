"""Text functions as column expressions. All offsets are code points, 0-based, half-open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pairs of outer markup that canonical text drops.
MARKUP_PAIRS = ["《》", "（）", "()", "【】", "[]", "<>", "“”", "「」", "『』"]


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """By Python's own tables: characters that fold to one other, and to several."""
    folds = {c: c.casefold() for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and c != c.casefold()}
    return {c: f for c, f in folds.items() if len(f) == 1}, {c: f for c, f in folds.items() if len(f) > 1}


_ONE, _MANY = _foldings()


#: What Java's lower case and an eszett's two letters fold as Python does, for a character class: letters up to U+024F but
#: for five, punctuation, signs, kana and ideographs.
_PLAIN = r"\u0000-\u00B4\u00B6-\u012F\u0131-\u0148\u014A-\u017E\u0180-\u01EF\u01F1-\u024F\u2000-\u206F\u20A0-\u20BF\u3000-\u312F\u4E00-\u9FFF"


def casefold(x: Column | str) -> Column:
    """Unicode case folding. Texts of one byte a character, and those of common letters, take short ways."""
    several = F.create_map(*(F.lit(y) for pair in _MANY.items() for y in pair))

    def fold(t: Column) -> Column:
        one = F.translate(t, "".join(_ONE), "".join(_ONE.values()))
        rare = F.array_join(F.transform(F.split(one, ""), lambda c: F.coalesce(F.try_element_at(several, c), c)), "")
        plain = F.replace(F.lower(t), F.lit("ß"), F.lit("ss"))
        return F.when(F.octet_length(t) == F.length(t), F.lower(t)).when(~t.rlike(f"[^{_PLAIN}]"), plain).when(t.rlike("[" + "".join(_MANY) + "]"), rare).otherwise(one)

    return bound(col(x), fold)


def bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x), with x computed once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def norm(x: Column | str) -> Column:
    """White space as single spaces, no margins, case folded. Null stays null."""
    return casefold(F.trim(F.regexp_replace(col(x), r"(?U)\s+", " ")))


def strip_markup(x: Column | str, pairs: list[str] = MARKUP_PAIRS) -> Column:
    """Without the pairs that enclose the whole text, nested ones too, until none is left. There can't be more layers
    than opening characters and spaces at the begin."""

    def peel(acc: Column, _: Column) -> Column:
        t = F.trim(acc)
        enclosed = F.lit(False)
        for p in pairs:
            enclosed = enclosed | (t.startswith(p[0]) & t.endswith(p[1]))
        return F.when((F.length(t) >= 2) & enclosed, F.trim(t.substr(F.lit(2), F.length(t) - 2))).otherwise(t)

    opening = "".join(sorted({f"\\{p[0]}" for p in pairs}))

    def strip(t: Column) -> Column:
        layers = F.length(F.regexp_extract(t, f"^[ {opening}]*", 0))
        return F.when(layers > 0, F.aggregate(F.sequence(F.lit(0), layers), t, peel)).otherwise(F.trim(t))

    return bound(col(x), strip)


def canonical_text(x: Column | str, pairs: list[str] = MARKUP_PAIRS) -> Column:
    return strip_markup(norm(x), pairs)


def content_length(x: Column | str) -> Column:
    """Word characters and CJK ideographs."""
    return F.length(F.regexp_replace(col(x), r"(?U)[^\w㐀-鿿]+", ""))


def clip(x: Column | str, limit: int = 180) -> Column:
    """At most so many characters, with an ellipsis for what is cut."""
    t = col(x)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(t.substr(1, limit - 1), r"(?U)\s+$", ""), F.lit("…")))


def relation_name(x: Column | str) -> Column:
    """Lower case, words and hyphens joined with underscores."""
    return F.regexp_replace(norm(F.regexp_replace(col(x), "-", " ")), " ", "_")


def label_key(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "")


def canonical_label(x: Column | str, allowed: list[str], fallback: str) -> Column:
    """Struct of label and known: the allowed label with the same letters and digits, else the fallback."""
    key = label_key(x)
    found = F.lit(None).cast("string")
    for a in reversed(allowed):
        found = F.when(key == label_key(F.lit(a)), F.lit(a)).otherwise(found)
    return F.struct(F.coalesce(found, F.lit(fallback)).alias("label"), found.isNotNull().alias("known"))


def language_hint(x: Column | str) -> Column:
    """zh with at least 10 ideographs that are a fifth of all letters, else en with at least 10 letters, else unknown."""
    t = F.coalesce(col(x), F.lit(""))
    cjk = F.length(F.regexp_replace(t, r"[^一-鿿]", ""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return F.when((cjk >= 10) & (cjk >= F.greatest(letters, F.lit(1)) * 0.2), "zh").when(letters >= 10, "en").otherwise("unknown")


def first_category(x: Column | str, patterns: dict[str, str], prefix: int | None = None) -> Column:
    """Name of the first pattern that is found, in any case, else 'other'. prefix: characters that are looked at."""
    t = F.coalesce(col(x), F.lit(""))
    t = t.substr(1, prefix) if prefix else t
    out = F.lit("other")
    for name, pattern in reversed(patterns.items()):
        out = F.when(t.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(out)
    return out


def boundary_overlap(a: Column | str, b: Column | str, threshold: float = 0.5) -> Column:
    """One non-empty text holds the other, and the shorter has the share of the longer at least."""
    a, b = norm(a), norm(b)
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.coalesce((short > 0) & (F.contains(a, b) | F.contains(b, a)) & (short >= threshold * long), F.lit(False))


def slice_text(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """text[start:end]."""
    return F.substring(col(text), col(start).cast("int") + 1, (col(end) - col(start)).cast("int"))


def overlapping_starts(text: Column | str, needle: Column | str) -> Column:
    """Starts of all occurrences, overlapping ones included; none for an empty needle."""
    t, n = col(text), col(needle)
    last = F.length(t) - F.length(n)
    spots = F.when((F.length(n) > 0) & (last >= 0) & F.contains(t, n), F.sequence(F.lit(0), last))
    return F.coalesce(F.filter(spots, lambda i: F.substring(t, i + 1, F.length(n)) == n), F.array().cast("array<int>"))


def before_marker(x: Column | str, marker: str = "\n\nKG_RULES:") -> Column:
    """What stands before the marker, without trailing white space."""
    return F.regexp_replace(F.substring_index(col(x), marker, 1), r"(?U)\s+$", "")


def source_group(path: Column | str) -> Column:
    return F.split_part(col(path), F.lit("/"), F.lit(1))


def inner_path(path: Column | str, skip: int = 2) -> Column:
    parts = F.split(col(path), "/")
    return F.array_join(F.slice(parts, skip + 1, F.greatest(F.size(parts) - skip, F.lit(0))), "/")


def shingle_array(x: Column | str, size: int = 5, step: int = 3, cap: int = 20_000) -> Column:
    """Distinct character shingles of the normal form, one every step characters. A shorter text is one shingle. Of
    more than cap, every n-th in sorted order stays."""

    def cut(t: Column) -> Column:
        n = F.length(t)
        starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1, F.lit(step))).otherwise(F.array(F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda i: F.substring(t, i, F.lit(size))))

    def thin(all_: Column) -> Column:
        every = F.greatest(F.floor(F.size(all_) / cap), F.lit(1))
        return F.when(F.size(all_) > cap, F.slice(F.filter(F.array_sort(all_), lambda _, k: k % every == 0), 1, cap)).otherwise(all_)

    # Each step is bound to a variable of a one-element array, so nothing is computed again for every shingle.
    text = F.array(norm(F.coalesce(col(x), F.lit(""))))
    return F.get(F.transform(F.transform(text, cut), thin), F.lit(0))


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))
