"""Word tables met in one pass over a text.

The words of a table become one trie, written as a regular expression, behind a look-ahead: every
place of the text is looked at once, and gives the longest word that begins there.  The shorter
words that begin at the same place are known from the table, so nothing that is listed is missed,
however many lists there are and however they overlap."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTER = "[\\p{L}\\p{N}_]"


def _escaped(char: str) -> str:
    return char if char.isalnum() or char == " " else "\\" + char


@lru_cache(maxsize=None)
def trie_pattern(words: tuple[str, ...]) -> str:
    """The words as nested alternatives by their letters, longer words first."""
    root: dict = {}
    for word in words:
        node = root
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def written(node: dict) -> str:
        parts = [_escaped(char) + written(below) for char, below in sorted(node.items()) if char]
        if not parts:
            return ""
        inner = parts[0] if len(parts) == 1 and "" not in node else "(?:" + "|".join(parts) + ")"
        return inner + ("?" if "" in node else "")
    return written(root)


def found(c: Column, words, whole: bool = False) -> Column:
    """The longest listed word at each place of the text where one begins, in order; ``whole``: only
    whole words."""
    body = trie_pattern(tuple(sorted(set(words))))
    pattern = f"(?<!{LETTER})(?=({body})(?!{LETTER}))" if whole else f"(?=({body}))"
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def _begins(word: str, other: str, whole: bool) -> bool:
    """Where ``other`` is found, ``word`` is found too."""
    if not other.startswith(word):
        return False
    return not whole or word == other or not (other[len(word)].isalnum() or other[len(word)] == "_")


def listed(c: Column, words, whole: bool = False) -> Column:
    """The distinct listed words that the text contains."""
    words = sorted(set(words))
    also = {w: [x for x in words if _begins(x, w, whole)] for w in words}
    hits = F.array_distinct(found(c, words, whole))
    longer = {w: xs for w, xs in also.items() if len(xs) > 1}
    if not longer:
        return hits
    table = F.create_map(*[x for w, xs in longer.items() for x in (F.lit(w), F.array(*map(F.lit, xs)))])
    return F.array_distinct(F.flatten(F.transform(hits, lambda w: F.coalesce(F.try_element_at(table, w), F.array(w)))))


def first_rank(c: Column, ranked: list[tuple[str, int]]) -> Column:
    """The lowest rank among the listed words that the text contains, NULL if it contains none."""
    lowest: dict[str, int] = {}
    for word, rank in ranked:
        lowest[word] = min(rank, lowest.get(word, rank))
    value = {w: min(r for x, r in lowest.items() if w.startswith(x)) for w in lowest}
    table = F.create_map(*[F.lit(x) for pair in value.items() for x in pair])
    return F.array_min(F.transform(found(c, lowest), lambda w: table[w]))
