"""Small regular-expression combinators.

Patterns in this package avoid look-around and named groups, and spell character classes out, so that they mean the
same in Java and in RE2 engines. What Spark runs is the pattern behind two cheap tests that no match can fail: one of its
words occurs in the lower-cased text (a byte search, once for the document), and the next character may begin a match (a
class to look ahead, which spares most positions the rest).
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Sequence
from functools import cache
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITESPACE = " \t\r\n"
WHITESPACE_SQL = r" \t\r\n"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expensive value so that a body reading it several times evaluates it once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Limits of the two tests: characters of a class, words of a choice, letters of a word.
MAX_FIRST, MAX_WORDS, MIN_LETTERS = 40, 8, 3
_REPEATS = (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT)


def _parsed(pattern: str) -> list | None:
    """The pattern as Python reads it; NULL for what Java reads otherwise, and for Unicode case."""
    if r"\v" in pattern or re.match(r"\(\?[a-z]*u", pattern):
        return None
    try:
        with warnings.catch_warnings():
            # Sets within sets are read with a warning.
            warnings.simplefilter("error", FutureWarning)
            return list(_parser.parse(pattern))
    except (re.error, OverflowError, FutureWarning):
        return None


def _first(items: list) -> tuple[set[int] | None, bool]:
    """(characters that can begin a match, NULL for any; whether the match may be empty)."""
    found: set[int] = set()
    for kind, value in items:
        empty = False
        if kind is op.LITERAL:
            own: set[int] | None = {value}
        elif kind is op.IN:
            own = set()
            for k, v in value:
                if k is op.LITERAL:
                    own.add(v)
                elif k is op.RANGE and v[1] - v[0] < MAX_FIRST:
                    own.update(range(v[0], v[1] + 1))
                elif (k, v) == (op.CATEGORY, op.CATEGORY_SPACE):
                    own.update(b" \t\n\r\f\v")
                else:
                    own = None
                    break
        elif kind is op.AT:
            continue
        elif kind is op.SUBPATTERN:
            own, empty = _first(list(value[3]))
        elif kind is op.BRANCH:
            parts = [_first(list(b)) for b in value[1]]
            own = None if any(c is None for c, _ in parts) else set().union(*(c for c, _ in parts))
            empty = any(e for _, e in parts)
        elif kind in _REPEATS:
            own, empty = _first(list(value[2]))
            empty = empty or value[0] == 0
        else:
            own = None
        if own is None:
            return None, False
        found |= own
        if not empty:
            return found, False
    return found, True


def _words(items: list) -> frozenset[str] | None:
    """Lower-cased words of which every match has one, NULL if none are known. Words are of ASCII characters."""
    choices: list[frozenset[str]] = []
    run = ""
    for kind, value in [*items, (None, None)]:
        if kind is op.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if len(run) >= MIN_LETTERS:
            choices.append(frozenset([run]))
        run = ""
        own: frozenset[str] | None = None
        if kind is op.SUBPATTERN:
            own = _words(list(value[3]))
        elif kind is op.BRANCH:
            parts = [_words(list(b)) for b in value[1]]
            own = None if any(p is None for p in parts) else frozenset().union(*parts)
        elif kind in _REPEATS and value[0] > 0:
            own = _words(list(value[2]))
        if own is not None and len(own) <= MAX_WORDS:
            choices.append(own)
    # The fewest words, the longest of them if in doubt; a word that holds another one says no more than that.
    kept = [frozenset(w for w in c if not any(x != w and x in w for x in c)) for c in choices]
    return min(kept, key=lambda c: (len(c), -min(map(len, c)), sorted(c)), default=None)


@cache
def words_of(pattern: str) -> tuple[str, ...]:
    """Words of which every match of the pattern has one, as in the lower-cased text; none if nothing is known."""
    items = _parsed(pattern)
    return tuple(sorted(_words(items) or ())) if items else ()


@cache
def quick(pattern: str) -> str:
    """The same pattern, with a class of the characters that can begin a match to look ahead."""
    items = _parsed(pattern)
    chars, empty = _first(items) if items else (None, True)
    if not chars or empty or len(chars) > MAX_FIRST:
        return pattern
    flags = re.match(r"(?:\(\?[a-z]+\))?", pattern).group()
    return f"{flags}(?=[{''.join(f'\\x{{{c:x}}}' for c in sorted(chars))}]){pattern[len(flags):]}"


def _guarded_sql(name: str, pattern: str, body: str) -> str:
    words = words_of(pattern)
    return f"CASE WHEN {' OR '.join(f'contains(lower(`{name}`), {literal(w)})' for w in words)} THEN {body} END" if words else body


def may_match(col: Column, pattern: str) -> Column | None:
    """False only if the pattern cannot occur, told without it; no column if there is no such test."""
    out = None
    for w in words_of(pattern):
        test = F.contains(F.lower(col), F.lit(w))
        out = test if out is None else out | test
    return out


def guarded(col: Column, pattern: str, body: Column) -> Column:
    """``body``, which is NULL without a match of the pattern, on the texts that may have one."""
    may = may_match(col, pattern)
    return body if may is None else F.when(may, body)


def literal(text: str) -> str:
    """SQL raw string literal of a pattern."""
    if "'" not in text:
        return f"r'{text}'"
    if '"' not in text:
        return f'r"{text}"'
    raise ValueError("a pattern may hold one kind of quote only")


def _group_sql(name: str, pattern: str, idx: int) -> str:
    capture = f"regexp_extract(`{name}`, {literal(quick(pattern))}, {idx})"
    return _guarded_sql(name, pattern, f"get(filter(array(trim(BOTH '{WHITESPACE_SQL}' FROM {capture})), v -> v <> ''), 0)")


def first_sql(name: str, patterns: Sequence[str], idx: int = 1) -> str:
    """SQL text of :func:`first_of` over a named column."""
    return f"coalesce({', '.join(_group_sql(name, p, idx) for p in patterns)}, NULL)"


def group(col: Column | str, pattern: str, idx: int = 1) -> Column:
    """Trimmed capture group of the first match, NULL when there is none or it is blank.

    The one-element filter binds the capture, so the pattern runs once; ``nullif`` would run it twice. A column given by
    name becomes one parsed expression, which keeps plans with hundreds of patterns quick to build.
    """
    if isinstance(col, str):
        return F.expr(_group_sql(col, pattern, idx))
    return guarded(col, pattern, F.get(F.filter(F.array(F.trim(F.regexp_extract(col, quick(pattern), idx), F.lit(WHITESPACE))), lambda v: v != ""), F.lit(0)))


def first_of(col: Column | str, patterns: Sequence[str], idx: int = 1) -> Column:
    """First pattern that captures something; later patterns are not evaluated once one has hit."""
    if isinstance(col, str):
        return F.expr(first_sql(col, patterns, idx))
    return F.coalesce(*[group(col, p, idx) for p in patterns])


def any_case(pattern: str) -> str:
    """Pattern that ignores case for all letters at ASCII cost: other letters are spelled out in both cases."""
    out, in_class = [], False
    for ch in pattern:
        in_class = (in_class or ch == "[") and ch != "]"
        both = ch.lower() + ch.upper()
        spelled = ord(ch) > 127 and ch.isalpha() and len(both) == 2 and both[0] != both[1]
        out.append((both if in_class else f"[{both}]") if spelled else ch)
    return "(?i)" + "".join(out)


def last_of(col: Column, patterns: Sequence[str], idx: int = 1) -> Column:
    """Last occurrence of the first pattern that occurs at all."""
    return F.coalesce(*[guarded(col, p, F.try_element_at(F.regexp_extract_all(col, F.lit(quick(p)), F.lit(idx)), F.lit(-1))) for p in patterns])


def all_of(col: Column, pattern: str, idx: int = 0) -> Column:
    """Every occurrence, as an array in text order."""
    return F.regexp_extract_all(col, F.lit(quick(pattern)), F.lit(idx))


def found(col: Column, pattern: str) -> Column:
    """Whether the pattern occurs; NULL for NULL."""
    test, may = F.rlike(col, F.lit(quick(pattern))), may_match(col, pattern)
    return test if may is None else may & test


def hit(col: Column, pattern: str) -> Column:
    """1 if the pattern occurs, else 0 (0 for NULL)."""
    return F.coalesce(found(col, pattern).cast("int"), F.lit(0))


def required_word(pattern: str) -> str | None:
    """Longest plain text every match of a pattern must contain, lower-cased; NULL where that is not obvious.

    Only patterns without alternatives and groups are looked at. Escapes, classes and quantified letters end a run.
    """
    if "|" in pattern or "(?" in pattern:
        return None
    plain = re.sub(r"\\.|\[[^\]]*\]|\{[^}]*\}|[().*+^$]", "\x00", pattern)
    # A letter before an optional quantifier may be absent.
    plain = re.sub(r".\?", "\x00", plain)
    quantified = {m.start() for m in re.finditer(r"[A-Za-z ](?=[*{])", pattern)}
    if quantified:
        return None
    word = max(plain.split("\x00"), key=len, default="")
    return word.lower() if len(word) >= 3 and re.fullmatch(r"[A-Za-z #:]+", word) else None


def hits(col: Column | str, patterns: Sequence[str], flags: str = "", lowered: str | None = None) -> Column:
    """Number of patterns that occur.

    With the name of a lower-cased copy of the text, patterns that need a certain word are tried only on texts that
    contain it: a byte search is far cheaper than a case-insensitive pattern.
    """
    if isinstance(col, str):
        terms = []
        for p in patterns:
            test = f"`{col}` rlike {literal(quick(flags + p))}"
            words = ([required_word(p)] if required_word(p) else words_of(flags + p)) if lowered else ()
            if words:
                test = f"(({' or '.join(f'contains(`{lowered}`, {literal(w)})' for w in words)}) and {test})"
            terms.append(f"int(coalesce({test}, false))")
        return F.expr(" + ".join(terms))
    total = F.lit(0)
    for p in patterns:
        total = total + hit(col, flags + p)
    return total


def has_any(col: Column | str, words: Sequence[str]) -> Column:
    """True if any of the plain words occurs (case as given)."""
    if isinstance(col, str):
        return F.expr("coalesce(" + " or ".join(f"contains(`{col}`, {literal(w)})" for w in words) + ", false)")
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(F.contains(col, F.lit(w)), F.lit(False))
    return out


def count_present(col: Column | str, words: Sequence[str]) -> Column:
    """Number of distinct words that occur at least once."""
    if isinstance(col, str):
        return F.expr(" + ".join(f"int(coalesce(contains(`{col}`, {literal(w)}), false))" for w in words))
    total = F.lit(0)
    for w in words:
        total = total + F.coalesce(F.contains(col, F.lit(w)).cast("int"), F.lit(0))
    return total


def blank_to_null(col: Column) -> Column:
    """Trimmed text, NULL if nothing is left."""
    return F.nullif(F.trim(col, F.lit(WHITESPACE)), F.lit(""))


def explode_rows(df: DataFrame, array: str, pos: str, value: str) -> DataFrame:
    """Rows of a computed array column, with positions; the array itself is dropped.

    The outer form is used on purpose: for the inner one the optimizer infers size and null filters on the array, pushes
    them below the projection and evaluates the whole extraction again for each of them.
    """
    rest = [c for c in df.columns if c != array]
    return df.select(*rest, F.posexplode_outer(array).alias(pos, value)).filter(F.col(pos).isNotNull())
