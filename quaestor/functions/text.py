"""Text functions as SQL expressions over a text column.

All run inside the engine, whole-stage compiled where Spark can; counts are of non-overlapping
substrings, without word boundaries unless said otherwise.  Limits on the text's length that
are part of a function's meaning are stated with it.
"""

from __future__ import annotations

from quaestor.functions import lexicons as L


def quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def occurrences(text: str, word: str) -> str:
    # most words are absent, and a look is cheaper than a copy of the text
    return f"CASE WHEN contains({text}, {quoted(word)}) THEN CAST((length({text}) - length(replace({text}, {quoted(word)}, ''))) / {len(word)} AS BIGINT) ELSE 0 END"


def count_of(text: str, word: str) -> str:
    """The same for a column of words."""
    return f"CAST((length({text}) - length(replace({text}, {word}, ''))) / length({word}) AS BIGINT)"


def hits(text: str, words: list[str]) -> str:
    """Occurrences of all words together; each engine has its own way (``bindings._dialect``)."""
    return f"HITS({text}, {', '.join(map(quoted, words))})"


def present(text: str, words: list[str]) -> str:
    """How many of the words occur."""
    return f"PRESENT({text}, {', '.join(map(quoted, words))})"


def each_hit(text: str, *words: str) -> str:
    return "(" + " + ".join(occurrences(text, unquoted(w)) for w in words) + ")"


def each_present(text: str, *words: str) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text}, {w}) THEN 1 ELSE 0 END" for w in words) + ")"


def unquoted(literal: str) -> str:
    return literal[1:-1].replace("''", "'")


def category_score(text: str, filename: str, words: list[str]) -> str:
    """Signals of a category in a text's head, five more for each in the file name."""
    return f"({hits(text, words)} + 5 * {present(filename, words)})"


def share(text: str, count: str, rate: float) -> str:
    """min(1, count / (rate * words)), to three places."""
    return f"round(least(CAST(1 AS DOUBLE), {count} / (CAST({rate} AS DOUBLE) * words)), 3)"


def tone(text: str, words: list[str]) -> str:
    """Occurrences per 1 000 characters."""
    return f"round(CAST(1000 AS DOUBLE) * {hits(text, words)} / greatest(length({text}), 1), 4)"


def risk(high: str, medium: str, low: str, risky: str, codewords: str, evasive: str, threatening: str) -> str:
    """0 to 1 from counts of flags by severity, of risky indicators and of code words, and from two intents' scores."""
    f = lambda x: f"CAST({x} AS DOUBLE)"
    total = f"{f(0.25)} * {high} + {f(0.15)} * {medium} + {f(0.05)} * {low} + {f(0.1)} * {risky} + least({f(0.2)}, {f(0.02)} * {codewords}) + CASE WHEN {evasive} > 0.3 THEN {f(0.1)} ELSE {f(0)} END + CASE WHEN {threatening} > 0.3 THEN {f(0.1)} ELSE {f(0)} END"
    return f"round(least({f(1)}, {total}), 3)"
