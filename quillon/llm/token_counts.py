"""Token counts that follow edits: a segment tree of pre-tokens for each document.

A text is cut into pre-tokens by a byte-level BPE vocabulary's pattern; no token crosses a pre-token, so
the count of a text is the sum over them. The tree's leaves are blocks of pre-tokens (length and count),
its inner nodes hold the sums of characters and tokens below. An edit re-reads the text from the pre-token
before it (the pattern looks ahead, never behind) until a bound of the old pre-tokens is met again; only
these are encoded, their block is replaced, and the sums on the way to the root are brought up to date.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern of the byte-level vocabularies; fixed values.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A match of the pattern depends on its own characters and at most this many after them.
LOOK_AHEAD = 2
#: Edits of the registered query: personal data and secrets give way to placeholders.
REDACTIONS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<EMAIL>"),
    (r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}|\b\d{3}-\d{2}-\d{4}\b", "<NUMBER>"),
    (r"\b[0-9a-f]{16,}\b|\b\d{13,19}\b", "<SECRET>"),
)


class Counter:
    """Counts of pre-tokens under a vocabulary, which are kept for words seen before."""

    def __init__(self, vocabulary: bytes, limit: int = 400_000):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encode = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pattern, self.limit, self.known = regex.compile(PATTERN), limit, {}

    def counts(self, words: list[str]) -> list[int]:
        known = self.known
        missing = set(words).difference(known)
        if missing:
            if len(known) + len(missing) > self.limit:
                known.clear()
                missing = set(words)
            for w in missing:
                known[w] = len(self.encode(w))
        return [*map(known.__getitem__, words)]


class Tree:
    """The pre-tokens of one text, with sums."""

    def __init__(self, text: str, counter: Counter, block: int = 64, known: tuple[list[int], list[int]] | None = None):
        """known: length and count of each pre-token, of a tree that was stored; nothing is encoded then."""
        self.text, self.counter, self.block, self.encoded = text, counter, block, 0
        if known is None:
            words = counter.pattern.findall(text)
            known = [*map(len, words)], counter.counts(words)
        self._build(*known)

    def stored(self) -> tuple[list[int], list[int]]:
        """Length and count of each pre-token, in order: what a tree is built from again."""
        return [n for l, _ in self.leaves for n in l], [n for _, c in self.leaves for n in c]

    def _build(self, lens: list[int], counts: list[int]) -> None:
        b = self.block
        self.leaves = [(lens[i : i + b], counts[i : i + b]) for i in range(0, len(lens), b)] or [([], [])]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (l, c) in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(l), sum(c)
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def locate(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at, and the leaf's first character."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at >= start + self.chars[node] and start + self.chars[node] < self.chars[1]:
                start += self.chars[node]
                node += 1
        return min(node - self.size, len(self.leaves) - 1), start

    def bounds(self, at: int) -> Iterator[tuple[int, int, int]]:
        """(leaf, index, end) of the pre-tokens from the one that holds character at."""
        leaf, end = self.locate(at)
        while leaf < len(self.leaves):
            for k, n in enumerate(self.leaves[leaf][0]):
                end += n
                if end > at:
                    yield leaf, k, end
            leaf += 1

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace characters start..end of the text by new ones, for edits in order that do not overlap."""
        parts, at = [], 0
        for start, end, new in edits:
            parts += [self.text[at:start], new]
            at = end
        self.text = text = "".join([*parts, self.text[at:]])
        k, shift = 0, 0  # the tree's text is the new one up to the last edit taken, then the old one, moved by shift
        while k < len(edits):
            start, end, new = edits[k]
            start, end, grown = start + shift, end + shift, len(new) - (end - start)
            old = self.bounds(max(0, start - LOOK_AHEAD - 1))
            first = last = next(old, None)
            begin = first[2] - self.leaves[first[0]][0][first[1]] if first else 0
            words, met = [], begin
            gone = first is None  # no old pre-tokens are left
            taken = 0
            for m in self.counter.pattern.finditer(text, begin):
                words.append(m.group())
                met = m.end() - grown  # where this is in the tree's text
                while k + 1 < len(edits) and met > edits[k + 1][0] + shift:
                    k += 1
                    s, e, new = edits[k]
                    end, grown = e + shift, grown + len(new) - (e - s)
                    met = m.end() - grown
                if met >= end:
                    while not gone and last[2] < met:
                        taken += 1
                        last = next(old, None) or (None, None, last[2])
                        gone = last[0] is None
                    if not gone and last[2] == met:
                        break
            else:
                while not gone:  # the text's end: all that was left is replaced
                    taken += 1
                    last = next(old, None) or (None, None, last[2])
                    gone = last[0] is None
                taken -= 1 if first else 0
            self._splice(first, taken + 1 if first else 0, words)
            shift += grown
            k += 1

    def _splice(self, first: tuple[int, int, int] | None, n: int, words: list[str]) -> None:
        """Put words in place of n pre-tokens from first on."""
        lens, counts = [*map(len, words)], self.counter.counts(words)
        self.encoded += len(words)
        leaf, k = (first[0], first[1]) if first else (len(self.leaves) - 1, len(self.leaves[-1][0]))
        touched = leaf
        while True:
            l, c = self.leaves[touched]
            here = min(n, len(l) - k)
            l[k : k + here], c[k : k + here] = (lens, counts) if touched == leaf else ([], [])
            n -= here
            if not n or touched + 1 == len(self.leaves):
                break
            touched, k = touched + 1, 0
        if len(self.leaves[leaf][0]) > 8 * self.block:
            flat = [*zip(*((x, y) for l, c in self.leaves for x, y in zip(l, c)))]
            self._build([*flat[0]], [*flat[1]])
            return
        nodes = set()
        for i in range(leaf, touched + 1):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(self.leaves[i][0]), sum(self.leaves[i][1])
            nodes.add((self.size + i) // 2)
        while nodes and nodes != {0}:
            for i in nodes:
                self._sum(i)
            nodes = {i // 2 for i in nodes}


def found_edits(text: str, rules: list[tuple[regex.Pattern, str]]) -> list[tuple[int, int, str]]:
    """The rules' matches in order; where two overlap the one that begins first stays (of these the earlier rule's)."""
    hits = sorted((m.start(), r, m.end(), new) for r, (p, new) in enumerate(rules) for m in p.finditer(text))
    out: list[tuple[int, int, str]] = []
    for start, _, end, new in hits:
        if not out or start >= out[-1][1]:
            out.append((start, end, new))
    return out


def legal_edits(edits: list | None, n: int) -> list[tuple[int, int, str]]:
    """Given edits clipped to the text and sorted; those that overlap an earlier one, or have a null bound, are left out."""
    out: list[tuple[int, int, str]] = []
    for start, end, new in sorted((min(max(e[0], 0), n), min(max(e[1], 0), n), e[2] or "") for e in edits or [] if e[0] is not None and e[1] is not None):
        if end >= start and (not out or start >= out[-1][1]):
            out.append((start, end, new))
    return out


_COUNTERS: dict[bytes, Counter] = {}


def counter_of(vocabulary: bytes) -> Counter:
    """One counter a worker process, so that known words outlive a task."""
    key = hashlib.sha256(vocabulary).digest()
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(vocabulary)
    return _COUNTERS[key]


EDITS = "array<struct<start:int,end:int,new:string>>"


def token_trees(docs: DataFrame, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, lens, counts and n_tokens of each row of docs: its tree, to be stored and edited later.

    Null and empty texts have empty trees. Repeated rows have a tree each; an empty table gives no rows."""
    empty = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(None).cast("array<int>").alias("lens"), F.lit(None).cast("array<int>").alias("counts"))
    return edited_trees(empty.withColumn("edits", F.lit(None).cast(EDITS)), vocabulary).drop("n_edits", "n_reencoded")


def edited_trees(trees: DataFrame, vocabulary: bytes, edits_col: str = "edits") -> DataFrame:
    """The trees (doc_id, text, lens, counts) after the edits of edits_col, in the same form, with n_tokens, n_edits and n_reencoded.

    Only pre-tokens that an edit touches, and those next to them, are encoded (n_reencoded); a tree whose lens is
    null is built first. Edits are taken as in token_counts; other columns do not matter."""
    some = trees.select("doc_id", "text", "lens", "counts", F.col(edits_col).alias("edits"))
    kind = some.schema["doc_id"].dataType.simpleString()
    shared = some.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(shared.value)
        for b in batches:
            for k in range(b.num_rows):
                text, lens, counts, edits = (b.column(c)[k].as_py() for c in ("text", "lens", "counts", "edits"))
                tree = Tree(text or "", counter, known=None if lens is None else (lens, counts))
                made = legal_edits([tuple(e.values()) for e in edits or []], len(tree.text))
                tree.edit(made)
                lens, counts = (pa.array([x], pa.list_(pa.int32())) for x in tree.stored())
                numbers = (pa.array([n], pa.int64()) for n in (tree.total, len(made), tree.encoded))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(k, 1), pa.array([tree.text]), lens, counts, *numbers], names=["doc_id", "text", "lens", "counts", "n_tokens", "n_edits", "n_reencoded"])

    return some.mapInArrow(run, f"doc_id {kind}, text string, lens array<int>, counts array<int>, n_tokens long, n_edits long, n_reencoded long")


def token_counts(docs: DataFrame, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None, rules: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, n_edits, n_tokens_edited, n_reencoded for each row of docs.

    Edits are those of edits_col (array of start, end, replacement in characters of the text), else the
    matches of rules. n_reencoded: pre-tokens that were encoded anew for them. Null and empty texts have no
    tokens (an edit may insert some). Edits that overlap an earlier one are left out. Repeated rows are
    counted each; texts are read whole; columns not named do not matter; an empty table gives no rows.
    A rule's match is taken where it begins first, of equal begins the earlier rule's; edits have no bound.
    For edits that come later, token_trees keeps the trees and edited_trees takes them up again."""
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (F.col(edits_col) if edits_col else F.lit(None).cast(EDITS)).alias("edits"))
    kind = some.schema["doc_id"].dataType.simpleString()
    shared = some.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(shared.value)
        compiled = [(regex.compile(p), new) for p, new in rules]
        for b in batches:
            out = []
            for text, edits in zip(b.column("text"), b.column("edits")):
                text = text.as_py() or ""
                tree = Tree(text, counter)
                made = legal_edits([tuple(e.values()) for e in edits.as_py() or []], len(text)) if edits_col else found_edits(text, compiled)
                before = tree.total
                tree.edit(made)
                out.append((before, sum(len(l) for l, _ in tree.leaves), len(made), tree.total, tree.encoded))
            columns = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, columns)], names=["doc_id", "n_tokens", "n_pretokens", "n_edits", "n_tokens_edited", "n_reencoded"])

    return some.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_pretokens long, n_edits long, n_tokens_edited long, n_reencoded long")
