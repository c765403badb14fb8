"""Finding, trimming and choosing spans in one text. Plain Python: used inside Pandas functions, one group at a time."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Hashable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+(?:[-_]\w+)*|\S")
# Fixed values: what ends a sentence, what may follow it, the least share of a part, and a crop's margin.
ENDERS, CLOSERS = ".!?。！？；;", "\"'”’）)"
LEAST_SHARE, MARGIN, CROP = 0.55, 120, 480
_JSON = re.compile(r'"(?:\\.|[^"\\])*"|[\[\]{}]|[^"\[\]{}]+', re.DOTALL)


def occurrences(text: str, needle: str, overlapping: bool = True) -> list[tuple[int, int]]:
    """Spans of exact occurrences."""
    out, at = [], text.find(needle) if needle else -1
    while at >= 0:
        out.append((at, at + len(needle)))
        at = text.find(needle, at + 1 if overlapping else at + len(needle))
    return out


def _loose(needle: str, flags: int = 0) -> re.Pattern | None:
    words = needle.split()
    return re.compile(r"\s+".join(map(re.escape, words)), flags) if words else None


def flexible_span(text: str, needle: str) -> tuple[int, int]:
    """The only span of the needle: exact, else with any white space between its words. ValueError if none or several."""
    found = occurrences(text, needle)
    if not found and (p := _loose(needle)):
        found = [m.span() for m in p.finditer(text)]
    if len(found) != 1:
        raise ValueError("ambiguous" if found else "not found")
    return found[0]


def matching_spans(text: str, needle: str) -> list[tuple[int, int]]:
    """All spans that don't overlap: exact ones, else with any white space between words."""
    found = occurrences(text, needle, overlapping=False)
    if not found and needle.split() != [needle] and (p := _loose(needle)):  # one word has no looser form
        found = [m.span() for m in p.finditer(text)]
    return found


def mention_spans(text: str, mention: str) -> list[tuple[int, int]]:
    """All exact spans that don't overlap, else those that differ in case only."""
    found = occurrences(text, mention, overlapping=False)
    return found or ([m.span() for m in re.finditer(re.escape(mention), text, re.IGNORECASE)] if mention else [])


def unique_in_segments(segments: Sequence[dict], needle: str) -> tuple[str, int, int]:
    """Segment id and global span, if one segment has the needle and only once. segments: segment_id, start, text."""
    found = [(s["segment_id"], s["start"] + a, s["start"] + b) for s in segments for a, b in matching_spans(s["text"], needle)]
    if len(found) != 1:
        raise ValueError("ambiguous" if found else "not found")
    return found[0]


def resolve_span(segments: Sequence[dict], text: str, segment_id: str | None = None, start: int | None = None) -> tuple[str, int | None, int | None]:
    """Status (resolved, not_found, ambiguous) and global span: given offsets if the text is there, else the only match
    in the named segment, else the only one in all segments."""
    named = [s for s in segments if s["segment_id"] == segment_id]
    for s in named:
        if start is not None and s["text"][start - s["start"] : start - s["start"] + len(text)] == text and text:
            return "resolved", start, start + len(text)
    for group in (named, segments):
        found = {(s["start"] + a, s["start"] + b) for s in group for a, b in matching_spans(s["text"], text)}
        if len(found) == 1:
            return ("resolved", *found.pop())
        if len(found) > 1:
            return "ambiguous", None, None
    return "not_found", None, None


def tokenize(text: str) -> list[tuple[str, int, int]]:
    """Tokens with their spans."""
    return [(m[0], *m.span()) for m in TOKEN.finditer(text)]


def token_span(offsets: Sequence[tuple[int, int]], start: int, end: int) -> tuple[int, int] | None:
    """First and end token whose borders are exactly these characters, or None."""
    first = {a: i for i, (a, _) in enumerate(offsets)}
    last = {b: i + 1 for i, (_, b) in enumerate(offsets)}
    return (first[start], last[end]) if start in first and end in last and first[start] < last[end] else None


def choose_spans(candidates: Sequence[tuple], mode: str = "longest") -> list[tuple]:
    """Spans (start, end, type[, score]) that don't overlap, in text order. Of equal ones the best score counts.

    longest: longer first, then by score, place and type. confidence: by score first.
    """
    best: dict[tuple, float] = {}
    for c in candidates:
        score = c[3] if len(c) > 3 else 0.0
        best[c[:3]] = max(best.get(c[:3], score), score)
    if mode == "confidence":
        rank = sorted(best, key=lambda k: (-best[k], -(k[1] - k[0]), k[0], k[2]))
    elif mode == "longest":
        rank = sorted(best, key=lambda k: (-(k[1] - k[0]), -best[k], k[0], k[2]))
    else:
        raise ValueError(f"unknown mode: {mode}")
    taken: list[tuple] = []  # in text order
    for k in rank:
        at = bisect_left(taken, k[:2])
        if k[1] > k[0] and (at == 0 or taken[at - 1][1] <= k[0]) and (at == len(taken) or k[1] <= taken[at][0]):
            taken.insert(at, k)
    width = len(candidates[0]) if candidates else 3
    return [(*k, best[k]) if width > 3 else k for k in taken]


def break_kind(text: str, at: int, begin: int, stop: int) -> int | None:
    """What kind of break ends at this place of text[begin:stop]: 0 a sentence, 1 a blank line, 2 a line, 3 white space."""
    last = text[at - 1]
    closed = last in CLOSERS and at - 2 >= begin and text[at - 2] in ENDERS
    if (last in ENDERS or closed) and (at == stop or text[at].isspace()):
        return 0
    if last == "\n":
        blank = text[begin : at - 1]
        return 1 if "\n" in blank[len(blank.rstrip()) :] else 2
    return 3 if last.isspace() else None


def break_point(text: str, start: int, hard_end: int, protected: Sequence[tuple[int, int]] = ()) -> int:
    """Where to end a part that may go to hard_end: after the last sentence, else blank line, line or white space in the
    last 45 %, and never inside a protected span."""
    seen: dict[int, int] = {}
    for at in range(hard_end, start + max(1, int((hard_end - start) * LEAST_SHARE)) - 1, -1):
        kind = break_kind(text, at, start, hard_end)
        if kind is not None:
            seen.setdefault(kind, at)
            if kind == 0:
                break
    end = seen[min(seen)] if seen else hard_end
    around = min(((a, b) for a, b in protected if a < end < b), default=None)
    if around and around[1] <= hard_end:
        return around[1]
    return around[0] if around and around[0] > start else end


def semantic_parts(text: str, size: int, overlap: int, protected: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Spans of at most size characters that break_point() ends, each beginning overlap characters before the last end."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap in [0, size)")
    n = len(text)

    def part(start: int) -> tuple[int, int]:
        reach = start + size
        return start, n if reach >= n else break_point(text, start, reach, protected)

    out = [part(0)]
    while out[-1][1] < n:
        out.append(part(max(out[-1][0] + 1, out[-1][1] - overlap)))
    return out


def focus(text: str, needles: Sequence[str], size: int = CROP) -> tuple[int, int]:
    """A span of about size characters around the first places of the needles, from a line's start to a sentence's end."""
    places = {text.find(n): n for n in needles if n and n in text}
    if not places or len(text) <= size:
        return 0, len(text)
    low, high = min(places), max(text.find(n) + len(n) for n in needles if n and n in text)
    room = min(len(text), max(size, high - low + MARGIN))
    left = min(max(low - (room - (high - low)) // 2, 0), len(text) - room)
    right = left + room
    left = max(left, text.rfind("\n", left, low) + 1)
    ends = (at for at in range(high + 1, right + 1) if break_kind(text, at, high, right) in (0, 1, 2))
    stop = next(ends, right)
    return left, stop if stop - left <= room else right


def close_json(text: str) -> str | None:
    """The text with the brackets that are missing, or None if that can't make it whole.

    Token by token: a closing brace first closes lists that are open inside its object, and a key closes a list that it
    would stand in; what is open at the end is closed there. A string without an end can't be mended."""
    parts: list[str] = []
    waiting: list[str] = []  # the closing brackets that are due, the next one last
    at = 0
    for m in _JSON.finditer(text):
        if m.start() != at:
            return None
        token, at = m[0], m.end()
        if token in ("{", "["):
            waiting.append("}" if token == "{" else "]")
        elif token in ("}", "]"):
            if token == "}" and token in waiting:
                while waiting[-1] == "]":
                    parts.append(waiting.pop())
            if not waiting or waiting.pop() != token:
                return None
        elif token[0] == '"' and waiting[-1:] == ["]"] and text[at:].lstrip()[:1] == ":":
            comma = bool(parts) and parts[-1].strip() == ","
            parts.insert(len(parts) - comma, waiting.pop())
        parts.append(token)
    if at != len(text):
        return None
    whole = "".join(parts)
    return (whole.rstrip().removesuffix(",") if waiting else whole) + "".join(reversed(waiting))


def extract_annotation(text: str) -> dict:
    """The last JSON object in the text that has entities and relations, brackets closed if need be. ValueError if none."""
    found = []
    for m in re.finditer(r"\{", text):
        part = text[m.start() :]
        try:
            value = json.JSONDecoder().raw_decode(part)[0]
        except json.JSONDecodeError:
            try:
                value = json.loads(close_json(part) or "")
            except json.JSONDecodeError:
                continue
        if isinstance(value, dict):
            found.append(value)
    whole = [v for v in found if "entities" in v and "relations" in v]
    if not whole:
        raise ValueError("no complete annotation" if found else "no JSON object")
    return whole[-1]


def unwrap_json(text: str) -> str:
    """What a code fence or other text around it encloses, from the first bracket to the last."""
    m = re.search(r"```(?:json)?\s*(.*?)```", text, re.DOTALL)
    body = m[1] if m else text
    at = [i for i in (body.find("{"), body.find("[")) if i >= 0]
    end = max(body.rfind("}"), body.rfind("]"))
    return body[min(at) : end + 1] if at and end >= min(at) else ""


def annotation_json(texts: Column | str) -> Column:
    """extract_annotation() as compact JSON with sorted keys; null if there is none."""

    def one(t: str | None) -> str | None:
        try:
            return json.dumps(extract_annotation(t or ""), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(texts)


def matching_spans_in(texts: Column | str, needles: Column | str) -> Column:
    """matching_spans() as an array of structs start, end."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in matching_spans(x or "", y or "")] for x, y in zip(t, n, strict=True)])

    return run(texts, needles)


#: White space as Java's (?U)\\s has it: Python's own but for four control characters.
_JAVA_SPACES = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not 0x1C <= ord(c) <= 0x1F) + "]+")
_CONTROLS = re.compile("[\x1c-\x1f]")


def norm_text(text: str) -> str:
    """What text.norm() gives, in plain Python."""
    return (_JAVA_SPACES.sub(" ", text).strip(" ") if _CONTROLS.search(text) else " ".join(text.split())).casefold()


class NameFinder:
    """The values of all names that are part of a text. A name without a blank is part of a word between blanks, so words
    are looked through once and remembered, up to so many of them; only names with blanks need the whole text."""

    KNOWN = 200_000

    def __init__(self, names: dict[str, Hashable]) -> None:
        import ahocorasick

        self._known: dict[str, tuple] = {}
        self._machines = []
        for blank in (False, True):
            machine = ahocorasick.Automaton()
            for name, value in names.items():
                if name and (" " in name) is blank:
                    machine.add_word(name, value)
            if len(machine):
                machine.make_automaton()
            self._machines.append(machine if len(machine) else None)

    def held(self, text: str) -> set:
        out: set = set()
        inner, whole = self._machines
        if inner is not None:
            known = self._known
            for word in set(text.split(" ")):
                got = known.get(word)
                if got is None:
                    if len(known) >= self.KNOWN:
                        known.clear()
                    got = known[word] = tuple({v for _, v in inner.iter(word)}) if word else ()
                if got:
                    out.update(got)
        if whole is not None and text:
            out.update(v for _, v in whole.iter(text))
        return out
