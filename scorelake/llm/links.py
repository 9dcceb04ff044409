"""URL filters: host and path rules and wildcard rules, all matched at once by a bit-parallel automaton.

A rule is ``host/path``. It fits its host and every subdomain of it when the path of the URL starts with the path of
the rule; both parts may hold ``*`` (any run of characters) and ``?`` (one byte). The rules become one row of bits,
one bit for each byte of each rule, packed into 64-bit words. One step of the automaton (multiword Shift-And with
self-loops for ``*``) moves all rules of all URLs of a batch over one more byte.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.arrays import buffers

Rule = tuple[str, str]
#: Ends the host in a canonical URL; can't stand inside one, so a wildcard never makes a path pass for a host.
BREAK = 0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both are empty for null and for a text without ``://``."""
    host = F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


class RuleAutomaton:
    """All rules as bit masks over the bytes of ``.host<BREAK>path``."""

    def __init__(self, rules: Sequence[str]) -> None:
        symbols: list[tuple[int | None, bool, bool]] = []  # byte (None: any), begins a rule, loops
        floating, finals = [], []
        for rule in rules:
            host, slash, path = rule.partition("/")
            if not slash or not host:
                raise ValueError(f"a rule needs a host and a path: {rule!r}")
            text = [*b"*.", *host.translate(str.maketrans(UPPER, LOWER)).encode(), BREAK, *f"/{path}*".encode()]
            begin, free = len(symbols), False
            for byte in text:
                if byte == ord("*"):
                    if len(symbols) == begin:
                        free = True
                    else:
                        symbols[-1] = (symbols[-1][0], symbols[-1][1], True)
                else:
                    symbols.append((None if byte == ord("?") else byte, len(symbols) == begin, False))
            floating += [begin] * free
            finals.append(len(symbols) - 1)
        self.words = len(symbols) // 64 + 1
        self.accept = np.zeros((256, self.words), np.uint64)
        for place, (byte, _, _) in enumerate(symbols):
            self.accept[slice(None) if byte is None else byte] |= self._bits([place])
        self.accept[BREAK] &= ~self._bits([i for i, s in enumerate(symbols) if s[0] is None])
        self.first = self._bits([i for i, s in enumerate(symbols) if s[1]])
        self.again = self._bits(floating)
        self.loop = self._bits([i for i, s in enumerate(symbols) if s[2]])
        self.finals = np.array(finals, np.int64)

    def _bits(self, places: Sequence[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for p in places:
            out[p // 64] |= np.uint64(1 << (p % 64))
        return out

    def run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text, which rules accept it: bool (texts, rules)."""
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        start, length = offsets[:-1][order], length[order]
        state = np.zeros((len(order), self.words), np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        alive = len(order)
        for t in range(int(length[0]) if len(length) else 0):
            alive = int(np.searchsorted(-length, -t, "left"))  # texts longer than t
            now = state[:alive]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= ~self.first
            moved |= self.again if t else self.first
            state[:alive] = (moved & self.accept[data[start[:alive] + t]]) | (now & self.loop)
        hit = (state[:, self.finals // 64] >> (self.finals % 64).astype(np.uint64)) & one
        out = np.empty(hit.shape, bool)
        out[order] = hit.astype(bool)
        return out


def screen_links(
    page_links: DataFrame,
    rules: Sequence[Rule],
    patterns: Sequence[Rule] = (),
    default: str = "allow",
    page_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Judge the image or document URL of every page.

    ``page_links``: one row per page (``page_id``, ``url``; other columns are dropped). ``rules`` and ``patterns`` are
    lists of (verdict, ``host/path`` rule). The longest fitting rule decides, at equal length the one with the longer
    host, then the earlier one; if no rule fits, the longest fitting pattern does, else ``default``.

    Returns (page_id, host, path, rule, pattern, verdict), one row per input row. A null URL, an empty one and one
    without ``://`` have an empty host and path and get ``default``. Repeated rows are judged each for itself.
    The rules travel in the task's closure: their number is that of a list written by hand.
    """
    verdicts = [v for v, _ in [*rules, *patterns]]
    texts = [r for _, r in [*rules, *patterns]]
    rank = lambda i: (i < len(rules), len(texts[i]), texts[i].index("/"), -i)
    order = sorted(range(len(texts)), key=rank, reverse=True)  # the best rule first
    machine = RuleAutomaton([texts[i] for i in order]) if order else None
    names, says = [texts[i] for i in order], [verdicts[i] for i in order]
    own = [i < len(rules) for i in order]

    host, path = url_parts(F.col(url_col))
    nul = "\x00"
    whole = F.concat(F.lit("."), F.translate(host, nul, "\x01"), F.lit(nul), F.translate(path, nul, "\x01"))
    rows = page_links.select(F.col(page_col), host.alias("host"), path.alias("path"), whole.alias("__whole"))
    schema = rows.drop("__whole").schema.add("rule", "string").add("pattern", "string").add("verdict", "string")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule_of = pa.array([n if o else None for n, o in zip(names, own, strict=True)] + [None], pa.string())
        pattern_of = pa.array([None if o else n for n, o in zip(names, own, strict=True)] + [None], pa.string())
        verdict_of = pa.array([*says, default], pa.string())
        for batch in batches:
            best = np.full(batch.num_rows, len(names), np.int64)
            if machine is not None and batch.num_rows:
                hits = machine.run(*buffers(batch.column("__whole")))
                best = np.where(hits.any(axis=1), hits.argmax(axis=1), best)
            best = pa.array(best)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], rule_of.take(best), pattern_of.take(best), verdict_of.take(best)],
                names=[page_col, "host", "path", "rule", "pattern", "verdict"],
            )

    return rows.mapInArrow(judge, schema)
