"""Document paths: names, extensions, ancestors, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME_CHARS = "[^/]"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """Everything before the last `/`; empty for a top-level file."""
    return path.substr(F.lit(1), F.length(path) - F.length(base_name(path)) - 1)


def stem(path: Column) -> Column:
    """File name without its extension; null where there is no dot."""
    name = base_name(path)
    return F.when(name.contains("."), F.regexp_extract(name, r"(?s)^(.*)\.[^.]*\z", 1))


def extension(path: Column) -> Column:
    """Text after the last dot of the file name; null where there is no dot."""
    name = base_name(path)
    return F.when(name.contains("."), F.substring_index(name, ".", -1))


def url_path(url: Column) -> Column:
    """The path of an absolute URL, without query and fragment."""
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)


def ancestors(path: Column) -> Column:
    """Directories above a file: `/a/b/c` gives `[/a, /a/b]`, `/c` gives `[]`."""
    parts = F.split(path, "/")
    # sequence() counts down when its end is below its start, so shallow paths go apart
    return F.when(
        F.size(parts) > 2,
        F.transform(
            F.sequence(F.lit(2), F.size(parts) - 1),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))


# --- globs -----------------------------------------------------------------


def expand_braces(glob: str) -> list[str]:
    """`a.{x,y}` → `a.x`, `a.y`; `{1..3}` counts; a brace with one item is literal text."""
    depth, start, commas = 0, -1, []
    at = 0
    while at < len(glob):
        ch = glob[at]
        if ch == "\\":
            at += 2
            continue
        if ch == "{":
            if depth == 0:
                start, commas = at, []
            depth += 1
        elif ch == "," and depth == 1:
            commas.append(at)
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                items = _brace_items(glob[start + 1 : at], [c - start - 1 for c in commas])
                if items is not None:
                    head, tails = glob[:start], expand_braces(glob[at + 1 :])
                    return [head + i + t for item in items for i in expand_braces(item) for t in tails]
        at += 1
    return [glob]


def _brace_items(body: str, commas: list[int]) -> list[str] | None:
    if commas:
        bounds = [-1, *commas, len(body)]
        return [body[a + 1 : b] for a, b in zip(bounds, bounds[1:])]
    counted = re.fullmatch(r"(-?\d+)\.\.(-?\d+)(?:\.\.(-?\d+))?", body)
    lettered = re.fullmatch(r"([a-zA-Z])\.\.([a-zA-Z])(?:\.\.(-?\d+))?", body)
    if not counted and not lettered:
        return None
    first, last, by = (counted or lettered).groups()
    low, high = (int(first), int(last)) if counted else (ord(first), ord(last))
    step = max(abs(int(by or 1)), 1)
    values = range(low, high + 1, step) if low <= high else range(low, high - 1, -step)
    if lettered:
        # letters between Z and a are punctuation, which stays literal
        return ["\\" + c if c in _MAGIC else c for c in map(chr, values)]
    padded = any(re.fullmatch(r"-?0\d+", n) for n in (first, last))
    width = max(len(first), len(last)) if padded else 0
    if len(values) > LONG_RANGE and step == 1 and min(low, high) >= 0 and not padded:
        # a range this long is one pattern, not so many globs
        return [f"{_RANGE}{min(low, high)}-{max(low, high)}{_RANGE}"]
    return [f"{n:0{width}d}" if width else str(n) for n in values]


# Ranges of more numbers become one regular expression; marks such a range inside an expanded glob.
LONG_RANGE, _RANGE, _MAGIC = 100, "\x00", "*?[]{}\\"


def number_regex(low: int, high: int) -> str:
    """The decimal numbers from `low` to `high`, without leading zeros."""
    tests, start = [], low
    while start <= high:
        # the longest block of `size` numbers that begins here: the last digits run over all values
        size = 1
        while start % (size * 10) == 0 and start and start + size * 10 - 1 <= high and len(str(start)) == len(str(start + size * 10 - 1)):
            size *= 10
        head, digits = str(start // size), len(str(size)) - 1
        # blocks that differ in the last digit of their head go together
        ten = start // size
        more = min(9 - ten % 10, (high - start + 1) // size - 1)
        if not start:
            more = min(9, high)
        top = ten + more
        tests.append(str(ten)[:-1] + (f"[{str(ten)[-1]}-{str(top)[-1]}]" if more else head[-1]) + (f"\\d{{{digits}}}" if digits else ""))
        start = (top + 1) * size
    return "(?:" + "|".join(tests) + ")"


def _segment_regex(segment: str) -> str:
    out, magic, at = "", False, 0
    while at < len(segment):
        ch = segment[at]
        at += 1
        if ch == _RANGE:
            end = segment.index(_RANGE, at)
            low, high = segment[at:end].split("-")
            out, at = out + number_regex(int(low), int(high)), end + 1
        elif ch == "*":
            out, magic = out + NAME_CHARS + "*", True
        elif ch == "?":
            out, magic = out + NAME_CHARS, True
        elif ch == "[" and "]" in segment[at + 1 :]:
            end = segment.index("]", at + 1)
            body = segment[at:end]
            negated = body[0] in "!^"
            body = body[1:] if negated else body
            safe = re.sub(r"([\\\[\]&^])", r"\\\1", body)
            out += f"[^/{safe}]" if negated else f"[{safe}]"
            at, magic = end + 1, True
        else:
            if ch == "\\" and at < len(segment):
                ch, at = segment[at], at + 1
            out += ch if ch.isalnum() or ord(ch) > 127 else "\\" + ch
    return (f"(?={NAME_CHARS})" if magic else "") + out


def _path_regex(glob: str) -> str:
    """A glob with `/`: whole-path match, `**` spanning any number of directories."""
    segments = glob.split("/")
    out = ""
    for n, segment in enumerate(segments):
        last = n == len(segments) - 1
        if segment == "**":
            out += ".+" if last else f"(?:{NAME_CHARS}*/)*"
        else:
            out += _segment_regex(segment) + ("" if last else "/")
    return out


class GlobList:
    """Globs of one list, compiled on the driver into regular expressions.

    A glob ending in `/` tests directories, any other tests files. A glob
    without `/` tests the last name only, wherever it stands; dot files match
    like all others and `#` has no special meaning.
    """

    def __init__(self, globs):
        self.file_names, self.file_paths = [], []
        self.dir_names, self.dir_paths = [], []
        for glob in globs or ():
            if glob.startswith("!") or re.search(r"[?*+@!]\(", glob):
                raise ValueError(f"negated and extended globs are not supported: {glob}")
            directory = glob.endswith("/")
            for one in expand_braces(glob[:-1] if directory else glob):
                if "/" in one:
                    (self.dir_paths if directory else self.file_paths).append(_path_regex(one))
                else:
                    (self.dir_names if directory else self.file_names).append(_segment_regex(one))

    def has_file_globs(self) -> bool:
        return bool(self.file_names or self.file_paths)

    def has_dir_globs(self) -> bool:
        return bool(self.dir_names or self.dir_paths)

    def matches_file(self, path: Column) -> Column:
        return path.rlike(_whole(self.file_names, self.file_paths))

    def matches_dir(self, path: Column) -> Column:
        return path.rlike(_whole(self.dir_names, self.dir_paths))

    def some_ancestor(self, path: Column) -> Column:
        """One of the directories above the file matches: a single regular expression."""
        tests = [f"(?:^|/)(?:{'|'.join(self.dir_names)})/"] if self.dir_names else []
        tests += [f"^(?:{'|'.join(self.dir_paths)})/"] if self.dir_paths else []
        return path.rlike("(?s)" + "|".join(tests))

    def every_ancestor(self, path: Column) -> Column:
        """All the directories above the file match."""
        if not self.dir_paths:
            return path.rlike(rf"(?s)^(?:/(?:{'|'.join(self.dir_names)}))*/[^/]*\z")
        return F.forall(ancestors(path), self.matches_dir)


def _whole(names: list[str], paths: list[str]) -> str:
    tests = [rf"(?:^|/)(?:{'|'.join(names)})\z"] if names else []
    tests += [rf"^(?:{'|'.join(paths)})\z"] if paths else []
    return "(?s)" + "|".join(tests)
