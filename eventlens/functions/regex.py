"""Regex filter dialect: the audited app evaluates patterns with RE2, Spark with java.util.regex.

``to_java_regex`` reads a pattern by recursive descent (alternatives, pieces,
atoms, classes), with the flags in force at each place, and writes the Java
pattern that matches the same texts (D5):

* ``$`` is the very end of the text (``\\z``), Java's also precedes a final
  line terminator; with ``(?m)`` both ``^`` and ``$`` stand at every ``\\n``.
* ``.`` matches ``\\r`` and U+2028 (UNIX_LINES, ``(?d)``), with ``(?s)``
  everything.
* ``\\b`` and ``\\B`` go by ASCII words, ``\\s`` lacks ``\\x0b``, ``\\v`` is ``\\x0b``.
* ``(?i)`` folds Unicode case (``(?iu)``), except that dotted and dotless i
  (U+0130, U+0131) fold to nothing else and sharp s folds to its capital.
  ``(?U)`` swaps greedy and lazy.
* ``{`` that opens no repetition, such as ``{,2}``, is itself; more than 1000
  repetitions and ``a**`` are errors.
  Scripts (``\\p{Greek}``) are not folded into.
* In a class ``[`` and ``&`` are members; ``[[:digit:]]``, ``\\p{Greek}``,
  ``\\pL``, octal escapes and ``(?P<name>`` get Java's spelling.

Look-around, atomic groups and back-references, which RE2 lacks, are passed on
to Java, as the app's own check of patterns accepts them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

REGEX_MARKER = "/"

# RE2's bracket classes [:name:] and their java.util.regex spellings.
POSIX_CLASSES = {
    "alnum": "\\p{Alnum}",
    "alpha": "\\p{Alpha}",
    "ascii": "\\p{ASCII}",
    "blank": "\\p{Blank}",
    "cntrl": "\\p{Cntrl}",
    "digit": "\\p{Digit}",
    "graph": "\\p{Graph}",
    "lower": "\\p{Lower}",
    "print": "\\p{Print}",
    "punct": "\\p{Punct}",
    "space": "\\s",
    "upper": "\\p{Upper}",
    "word": "\\w",
    "xdigit": "\\p{XDigit}",
}
_POSIX = re.compile(r"\[:(\^?)([a-z]+):\]")
_REPEAT = re.compile(r"\{(\d+)(,?)(\d*)\}")
_FLAGS = re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])")
_NAMED = re.compile(r"\(\?P?<([^=!>][^>]*)>")
_PASSED_ON = re.compile(r"\(\?(?:[=!>]|<[=!])")
_MOST_REPEATS = 1000

_WORD = "[0-9A-Za-z_]"
_BOUNDARY = {
    "b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))",
    "B": f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))",
}
#: Members of ASCII classes of letters where case is folded: long s and the Kelvin sign fold into them.
_FOLDED = {
    name: members + "\u017f\u212a"
    for name, members in {
        "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "lower": "A-Za-z", "upper": "A-Za-z", "word": "0-9A-Za-z_"
    }.items()
}
#: Dotted and dotless i, which Java folds to i.
_ODD_I = "\u0130\u0131"


def is_regex_term(term: str) -> bool:
    """A filter term is a regex when it starts with ``/`` and has a body."""
    return isinstance(term, str) and term.startswith(REGEX_MARKER) and len(term) > 1


def strip_marker(pattern: str) -> str:
    """Drop one leading ``/`` (a trailing one is part of the pattern)."""
    return pattern[1:] if pattern.startswith(REGEX_MARKER) else pattern


@dataclass(frozen=True)
class _Flags:
    """What is in force at a place of a pattern."""

    fold: bool = False
    lines: bool = False
    all: bool = False
    lazy: bool = False

    def changed(self, on: str, off: str | None) -> _Flags:
        names = {"i": "fold", "m": "lines", "s": "all", "U": "lazy"}
        return replace(self, **{names[c]: True for c in on}, **{names[c]: False for c in off or ""})


class _Reader:
    """One pass over an RE2 pattern."""

    def __init__(self, pattern: str) -> None:
        self.pattern, self.at = pattern, 0

    def fail(self, why: str) -> ValueError:
        return ValueError(f"invalid regular expression {self.pattern!r}: {why}")

    def more(self) -> bool:
        return self.at < len(self.pattern)

    def take(self, regex: re.Pattern) -> re.Match | None:
        found = regex.match(self.pattern, self.at)
        if found:
            self.at = found.end()
        return found

    def alternatives(self, flags: _Flags, depth: int) -> str:
        """To the end of the group or of the pattern; flags that are set hold for what follows, ``|`` included."""
        out: list[str] = []
        while self.more():
            ch = self.pattern[self.at]
            if ch == ")" and depth:
                break
            if ch == "|":
                out.append("|")
                self.at += 1
                continue
            if (found := self.flag_group()) is not None:
                after = flags.changed(*found)
                if after.fold != flags.fold:
                    out.append("(?iu)" if after.fold else "(?-iu)")
                flags = after
                continue
            out.append(self.piece(flags, depth))
        return "".join(out)

    def flag_group(self) -> tuple[str, str | None] | None:
        found = _FLAGS.match(self.pattern, self.at)
        if found is None or found.group(3) != ")" or found.group() == "(?)":
            return None
        self.at = found.end()
        return found.group(1), found.group(2)

    def piece(self, flags: _Flags, depth: int) -> str:
        atom = self.atom(flags, depth)
        repeat = self.repeat(flags)
        if repeat and self.repeat(flags):
            raise self.fail("a repetition of a repetition")
        return atom + repeat

    def repeat(self, flags: _Flags) -> str:
        if not self.more():
            return ""
        if self.pattern[self.at] in "*+?":
            out = self.pattern[self.at]
            self.at += 1
        elif found := self.take(_REPEAT):
            least, most = int(found.group(1)), int(found.group(3) or found.group(1))
            if max(least, most) > _MOST_REPEATS or most < least:
                raise self.fail(f"invalid repetition {found.group()}")
            out = found.group()
        else:
            return ""
        lazy = self.pattern.startswith("?", self.at)
        self.at += lazy
        return out + ("?" if lazy != flags.lazy else "")

    def atom(self, flags: _Flags, depth: int) -> str:
        ch = self.pattern[self.at]
        if ch == "(":
            return self.group(flags, depth)
        if ch == "[":
            return self.set_of(flags)
        if ch == "\\":
            return self.escape(flags)
        self.at += 1
        if ch == ".":
            return "(?s:.)" if flags.all else "."
        if ch == "^":
            return "(?:^|(?<=\\n))" if flags.lines else "^"
        if ch == "$":
            return "(?:\\z|(?=\\n))" if flags.lines else "\\z"
        if ch in "*+?":
            raise self.fail(f"nothing to repeat before {ch}")
        if ch == ")":
            raise self.fail("unexpected )")
        return self.literal(ch, flags)

    def literal(self, ch: str, flags: _Flags) -> str:
        for both in ("iI", "\u00df\u1e9e"):  # letters that Java folds to more, or to less
            if flags.fold and ch in both:
                return f"(?-iu:[{both}])"
        if flags.fold and ch in _ODD_I:
            return f"(?-iu:{ch})"
        return "\\" + ch if ch in "{}[]()*+?.^$|\\" else ch

    def group(self, flags: _Flags, depth: int) -> str:
        if found := self.take(_PASSED_ON):
            opened = found.group()
        elif found := self.take(_NAMED):
            name = found.group(1)
            opened = f"(?<{name}>" if re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", name) else "("
        elif (found := _FLAGS.match(self.pattern, self.at)) and found.group(3) == ":":
            self.at = found.end()
            after = flags.changed(found.group(1), found.group(2))
            opened = "(?:" if after.fold == flags.fold else "(?iu:" if after.fold else "(?-iu:"
            flags = after
        elif self.pattern.startswith("(?", self.at):
            raise self.fail("unknown group")
        else:
            self.at += 1
            opened = "("
        inside = self.alternatives(flags, depth + 1)
        if not self.more():
            raise self.fail("missing )")
        self.at += 1
        return opened + inside + ")"

    def escape(self, flags: _Flags) -> str:
        """An escape outside a class."""
        if self.pattern.startswith("\\Q", self.at):
            end = self.pattern.find("\\E", self.at + 2)
            quoted = self.pattern[self.at + 2 : len(self.pattern) if end < 0 else end]
            self.at = len(self.pattern) if end < 0 else end + 2
            if flags.fold:
                return "".join(self.literal(c, flags) for c in quoted)
            return f"\\Q{quoted}\\E" if quoted else ""
        ch = self.pattern[self.at + 1 : self.at + 2]
        if ch in _BOUNDARY:
            self.at += 2
            return f"(?-iu:{_BOUNDARY[ch]})" if flags.fold else _BOUNDARY[ch]
        if ch in "AzC" and ch:
            self.at += 2
            return "(?s:.)" if ch == "C" else "\\" + ch
        if ch in "123456789" and ch and not re.match(r"[1-7][0-7]", self.pattern[self.at + 1 :]):
            self.at += 2
            return "\\" + ch
        inner = self.member_escape(flags)
        if flags.fold and ch in "wW":
            return f"(?-iu:[{inner}])"
        return f"[{inner}]" if inner.startswith("\\t\\n") else inner

    def member_escape(self, flags: _Flags) -> str:
        """An escape that may stand in a class."""
        rest = self.pattern[self.at + 1 :]
        if not rest:
            raise self.fail("a trailing \\")
        ch = rest[0]
        if found := re.match(r"[pP](?:\{(\^?)([^}]*)\}|(.))", rest):
            self.at += 1 + found.end()
            inverse = (ch == "P") != (found.group(1) == "^")
            name = found.group(3) or found.group(2)
            if name == "Any":
                return "[^\\x{0}-\\x{10FFFF}]" if inverse else "[\\x{0}-\\x{10FFFF}]"
            name = name if len(name) <= 2 or name.startswith("Is") else "Is" + name
            return f"\\{'P' if inverse else 'p'}{{{name}}}"
        if found := re.match(r"x\{([0-9A-Fa-f]+)\}|x([0-9A-Fa-f]{2})|(0[0-7]{0,2}|[1-7][0-7]{1,2})", rest):
            self.at += 1 + found.end()
            code = int(found.group(3), 8) if found.group(3) else int(found.group(1) or found.group(2), 16)
            return f"\\x{{{code:x}}}"
        self.at += 2
        if flags.fold and ch in "wW":
            return _FOLDED["word"] if ch == "w" else f"[^{_FOLDED['word']}]"
        if ch == "s":
            return "\\t\\n\\f\\r "
        if ch == "S":
            return "[^\\t\\n\\f\\r ]"
        if ch == "v":
            return "\\x0b"
        if ch in "dDwWafnrt":
            return "\\" + ch
        if ch.isascii() and (ch.isalnum() or ch == "_"):
            raise self.fail(f"unknown escape \\{ch}")
        return "\\" + ch

    def set_of(self, flags: _Flags) -> str:
        """A character class."""
        self.at += 1
        negated = self.pattern.startswith("^", self.at)
        self.at += negated
        out: list[str] = []
        while True:
            if not self.more():
                raise self.fail("missing ]")
            ch = self.pattern[self.at]
            if ch == "]" and out:
                self.at += 1
                break
            posix = _POSIX.match(self.pattern, self.at)
            if posix and posix.group(2) in POSIX_CLASSES:
                java = POSIX_CLASSES[posix.group(2)]
                if flags.fold and posix.group(2) in _FOLDED:
                    java = f"[^{_FOLDED[posix.group(2)]}]" if posix.group(1) else _FOLDED[posix.group(2)]
                elif posix.group(1):  # [:^name:] is the complement
                    java = {"\\s": "\\S", "\\w": "\\W"}.get(java, java.replace("\\p", "\\P"))
                out.append(java)
                self.at = posix.end()
            elif ch == "\\":
                out.append(self.member_escape(flags))
            else:
                out.append("\\" + ch if ch in "[&" or (ch == "^" and not out) else ch)
                self.at += 1
        java = ("[^" if negated else "[") + "".join(out) + "]"
        if flags.fold:  # the odd letters i are members only as they stand
            return f"(?:(?-iu:(?=[{_ODD_I}]){java})|(?-iu:(?![{_ODD_I}])){java})"
        return java


def to_java_regex(pattern: str, options: str = "") -> str:
    """RE2 pattern -> java.util.regex pattern with the same matches; ``ValueError`` if RE2 cannot read it.

    ``options`` are those of ``regexp_matches``: ``i`` folds case (``c`` does
    not), with ``s`` a ``.`` matches ``\\n`` (``m``, ``n``, ``p``: not),
    with ``l`` the pattern is a literal text.
    """
    if unknown := set(options) - set("cilmnps"):
        raise ValueError(f"unknown option of regexp_matches: {sorted(unknown)[0]!r}")
    flags = _Flags()
    for option in options:
        if option in "ci":
            flags = replace(flags, fold=option == "i")
        elif option in "smnp":
            flags = replace(flags, all=option == "s")
    reader = _Reader(pattern)
    if "l" in options:
        body = "".join(reader.literal(c, flags) for c in pattern)
    else:
        body = reader.alternatives(flags, 0)
    return "(?d)" + ("(?iu)" if flags.fold else "") + body


# Patterns java.util.regex already compiled (validity depends on nothing else).
_VALID: set[str] = set()
_VALID_MOST = 10_000


def validate_patterns(spark: SparkSession, patterns: list[str]) -> None:
    """Raise ``ValueError`` for a pattern Java cannot compile.

    The check folds ``'' RLIKE p`` over an empty relation: the optimizer
    compiles the literal patterns on the driver and no task runs. All
    patterns are checked in one fold; only on failure are they retried one
    by one to name the culprit.
    """
    patterns = [p for p in dict.fromkeys(patterns) if p not in _VALID]
    if not patterns:
        return
    try:
        spark.range(0).select(*[F.lit("").rlike(p) for p in patterns]).collect()
        if len(_VALID) > _VALID_MOST:
            _VALID.clear()
        _VALID.update(patterns)
        return
    except Exception:  # noqa: BLE001 - find which pattern failed below
        pass
    for p in patterns:
        try:
            spark.range(0).select(F.lit("").rlike(p)).collect()
        except Exception as exc:  # noqa: BLE001 - any compile failure is a bad pattern
            msg = str(exc).splitlines()[0][:300]
            raise ValueError(f"invalid regular expression {p!r}: {msg}") from None
    raise ValueError(f"invalid regular expression among {patterns!r}")
