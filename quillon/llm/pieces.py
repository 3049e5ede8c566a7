"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A model file gives pieces and scores. Texts are split where no piece can span (before a run of spaces, and
around characters such as line ends that no longer piece holds), and each distinct stretch, a word, is
solved once. Words of equal length advance together: at every position the substrings that end there are
looked up by hash in the sorted keys of the pieces, candidates are compared across the whole batch, and a
vectorised maximum stores the backpointer.

What a candidate is worth depends on the model's type. In a unigram model it is the best score at its start
plus the piece's. In a BPE model the segmentation that repeated merging gives is the one path in which each
piece and the piece before it stay apart when the two alone are merged; so a candidate is worth 0 if it may
follow the best piece at its start and minus infinity if not, and exactly one candidate is left at every
position. Which pairs stay apart is worked out once a pair. Both agree with the library id by id.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.textcode import mix

UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
#: An unknown character scores this much less than the lowest piece, as in the library.
UNKNOWN_PENALTY = 10.0
#: Ids from here on stand for single characters that are no piece, until they are written as bytes.
CHARS = 1 << 24
#: Places of the table of pairs that were worked out.
PAIR_BITS = 21
#: Bits by which hashes that are no piece's are told before the search.
FIRST_BITS = 18
#: Characters that advance together.
BATCH = 100_000
#: Longer words of BPE models are cut into stretches of so many characters, with the same ids.
LONG, STRETCH = 2048, 512


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class Model:
    """A SentencePiece model file, of type unigram or BPE, whose normaliser leaves characters as they are."""

    def __init__(self, data: bytes, kind: int | None = None):
        """kind: takes the model for one of this type, whatever the file says (for tests)."""
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer: dict = {}
        norm: dict = {}
        for number, value in fields(data):
            if number == 1:
                f = dict(fields(value))
                self.pieces.append(f[1].decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.types.append(f.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                norm = dict(fields(value))
        self.kind = kind or trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or norm.get(1, b"") not in (b"identity", b"") or norm.get(2) or norm.get(4, 1) or USER in self.types or trainer.get(24):
            raise ValueError("only unigram and BPE models without normalisation and user-defined pieces are supported")
        self.dummy = bool(norm.get(3, 1))
        self.unknown = self.types.index(UNKNOWN)
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.low = min((self.scores[i] for i in self.ids.values()), default=0.0)
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        hard = "".join(c for c in "\n\t\r" if c not in joined)
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.split = re.compile(rf"(?s).+" if inner else rf"{SPACE}*[^{SPACE}{hard}]+|{SPACE}+" + (f"|[{hard}]" if hard else ""))
        self._sort_keys()
        self.pair_keys, self.pair_apart = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_limit = 200_000
        self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, t in zip(self.pieces, self.types)]

    def _sort_keys(self) -> None:
        """For each length the pieces' hashes in order, their ids, and which first bits of hashes occur, so that few others are searched for."""
        by: dict[int, list[int]] = {}
        for p, i in self.ids.items():
            by.setdefault(len(p), []).append(i)
        self.keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, ids in by.items():
            rows = np.frombuffer("".join(self.pieces[i] for i in ids).encode("utf-32-le"), np.uint32).reshape(len(ids), n)
            h = substring_hashes(rows, n)[:, 0]
            order = np.argsort(h)
            assert len(np.unique(h)) == len(h), "two pieces have one hash"
            begin = np.zeros(1 << FIRST_BITS, bool)
            begin[h >> np.uint64(64 - FIRST_BITS)] = True
            self.keys[n] = h[order], np.array(ids, np.int64)[order], begin
        self.score = np.array(self.scores, np.float32)

    def name(self, i: int) -> str:
        return chr(i - CHARS) if i >= CHARS else self.pieces[i]

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether merging a + b gives the symbols a and b: best score first and of equals the leftmost, until no pair is a piece."""
        parts, border, ids, scores = [*a, *b], len(a), self.ids, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                break
            if at == border - 1 and a:
                return False  # this merge takes from both
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            border -= at < border
        return parts == ([a, b] if a else [b])

    def may_follow(self, pairs: np.ndarray) -> np.ndarray:
        """For each before << 26 | after: whether the two stay apart when merged alone; before is CHARS - 1 at the start.

        Answers are kept in a table with one place for each hash; a pair that finds another there is worked out again."""
        at = (mix(pairs.astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.pair_apart[at]
        new = np.flatnonzero(self.pair_keys[at] != pairs)
        if len(new):
            found, where = np.unique(pairs[new], return_inverse=True)
            apart = np.empty(len(found), bool)
            for k, key in enumerate(found.tolist()):
                before, after = key >> 26, key & ((1 << 26) - 1)
                a, b = "" if before == CHARS - 1 else self.name(before), self.name(after)
                apart[k] = self.stay_apart(a, b)
            out[new] = apart[where]
            place = (mix(found.astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
            self.pair_keys[place], self.pair_apart[place] = -1, False
            place, first = np.unique(place, return_index=True)  # of pairs with one place the first is kept
            self.pair_keys[place], self.pair_apart[place] = found[first], apart[first]
        return out

    def advance(self, chars: np.ndarray, settled: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For rows of characters: the piece that ends at each place of each row, and its length.

        settled: the pieces known to end at the first places, from place 0 on."""
        n, size = chars.shape
        reach = min(self.longest, size)
        ids = np.full((reach + 1, n, size), -1, np.int64)  # [length, word, end - 1]
        for k, (keys, pieces, begin) in self.keys.items():
            if k <= reach:
                h = substring_hashes(chars, k)
                some = begin[h >> np.uint64(64 - FIRST_BITS)]
                h = h[some]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                ids[k][:, k - 1 :][some] = np.where(keys[at] == h, pieces[at], -1)
        ids[1] = np.where(ids[1] < 0, chars.astype(np.int64) + CHARS, ids[1])
        bpe = self.kind == BPE
        best = np.zeros((n, size + 1), np.float32)
        last = np.full((n, size + 1), CHARS - 1, np.int64)
        back = np.zeros((n, size + 1), np.int32)
        first = 1
        if settled is not None:
            first = settled.shape[1]
            last[:, :first] = settled
        rows = np.arange(n)
        for end in range(first, size + 1):
            span = np.arange(min(reach, end), 0, -1)  # the longest first: of equals it wins
            some = ids[span, :, end - 1].T
            if bpe:
                worth = np.full(some.shape, -np.inf, np.float32)
                w, k = np.nonzero(some >= 0)
                worth[w, k] = np.where(self.may_follow(last[w, end - span[k]] << 26 | some[w, k]), 0, -np.inf)
            else:
                own = np.where(some >= CHARS, np.float32(self.low - UNKNOWN_PENALTY), self.score[np.where(some >= CHARS, 0, some)])
                worth = np.where(some >= 0, best[:, end - span] + own, -np.inf)
            pick = worth.argmax(1)
            best[:, end], last[:, end], back[:, end] = worth[rows, pick], some[rows, pick], span[pick]
        return last, back

    def solve_long(self, word: str) -> bytes:
        """The ids of one long word of a BPE model, in stretches that advance together.

        Each stretch begins some characters early, as if a word began there. What ends at a place depends on
        the `longest` places before it alone, so where these come out as the stretch before has them, so does
        all that follows; a stretch in which they do not is gone through again from them."""
        chars = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        size, reach, early = len(chars), self.longest, 4 * self.longest
        last, back = np.empty(size + 1, np.int64), np.empty(size + 1, np.int32)
        last[: STRETCH + 1], back[: STRETCH + 1] = (x[0] for x in self.advance(chars[None, :STRETCH]))
        begins = list(range(STRETCH, size, STRETCH))
        step = max(1, BATCH // (STRETCH + early))
        for group in (begins[at : at + step] for at in range(0, len(begins), step)):
            whole = [b for b in group if b + STRETCH <= size]
            made = {}
            if whole:
                made = dict(zip(whole, zip(*self.advance(np.stack([chars[b - early : b + STRETCH] for b in whole])))))
            for b in group:
                end = min(b + STRETCH, size)
                ends, spans = made[b] if b in made else (x[0] for x in self.advance(chars[None, b - early : end]))
                if not np.array_equal(ends[early - reach + 1 : early + 1], last[b - reach + 1 : b + 1]):
                    ends, spans = (x[0] for x in self.advance(chars[None, b - reach : end], last[None, b - reach : b + 1]))
                last[b + 1 : end + 1], back[b + 1 : end + 1] = ends[b - end :], spans[b - end :]
        ends, at = np.zeros(size + 1, bool), size
        while at > 0:
            ends[at] = True
            at -= int(back[at])
        path = last[ends]
        return self.written(path.tolist()) if (path >= CHARS).any() else path.astype("<i4").tobytes()

    def solve(self, words: list[str]) -> list[bytes]:
        """The ids of words that all have one length, as little-endian int32."""
        n, size = len(words), len(words[0])
        if self.kind == BPE and size > LONG and 4 * self.longest <= STRETCH:
            return [self.solve_long(w) for w in words]
        last, back = self.advance(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, size))
        rows = np.arange(n)
        path, used = np.zeros((n, size), np.int64), np.zeros((n, size), bool)
        at, going = np.full(n, size), rows
        for k in range(size - 1, -1, -1):
            path[going, k], used[going, k] = last[going, at], True
            at = at - back[going, at]
            going, at = going[at > 0], at[at > 0]
            if not len(going):
                break
        flat, counts = path[used], used.sum(1)
        cuts = np.concatenate(([0], np.cumsum(counts)))
        data = flat.astype("<i4").tobytes()
        odd = set(np.flatnonzero(((path >= CHARS) & used).any(1)).tolist())
        bounds = cuts.tolist()
        return [data[4 * a : 4 * b] if w not in odd else self.written(flat[a:b].tolist()) for w, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]

    def written(self, path: list[int]) -> bytes:
        """Ids as little-endian int32; characters that are no piece become byte pieces, or the unknown id."""
        out: list[int] = []
        unknown = False
        for i in path:
            if i < CHARS:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in chr(i - CHARS).encode("utf-8", "replace")]
            elif not unknown:
                out.append(self.unknown)
            unknown = i >= CHARS  # neighbouring unknown characters are one
        return np.array(out, "<i4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian int32; none for null and empty texts."""
        split = [self.split.findall((SPACE * self.dummy + t).replace(" ", SPACE)) if t else [] for t in texts]
        words = set().union(*split)
        missing = words.difference(self.cache)
        if len(self.cache) + len(missing) > self.cache_limit:
            self.cache, self.older = {}, self.cache
            missing = words
        for w in missing & self.older.keys():
            self.cache[w] = self.older[w]
        missing = missing.difference(self.cache)
        by: dict[int, list[str]] = {}
        for w in missing:
            by.setdefault(len(w), []).append(w)
        for size, words in by.items():
            step = max(1, BATCH // size)
            for at in range(0, len(words), step):
                part = words[at : at + step]
                self.cache.update(zip(part, self.solve(part)))
        get = self.cache.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids (little-endian int32)."""
        data = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return data.decode("utf-8", "replace")[1 if self.dummy and data[:1] == b" " else 0 :]


def substring_hashes(rows: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all substrings of n characters in each row."""
    out = np.zeros((rows.shape[0], rows.shape[1] - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out + rows[:, k : rows.shape[1] - n + 1 + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return mix(out, n)


_MODELS: dict[bytes, Model] = {}


def model_of(data: bytes) -> Model:
    """One model a worker process, so that its caches outlive a task."""
    key = hashlib.sha256(data).digest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(data)
    return _MODELS[key]


def read_model(path: str) -> bytes:
    """The model file on the driver; executors get its bytes (some 0.5 MB) with the task."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array of int), round_trip and ids_sha256 for each row of docs.

    round_trip: decoding gives the text again (a U+2581 in it comes back as a space, as in the library).
    ids_sha256: of the ids as little-endian int32. Null and empty texts have no ids, and round_trip is true.
    Repeated rows are encoded each; texts of any length are encoded whole; columns not named do not matter.
    Ways of equal score (unigram models) go by the longest last piece. An empty table gives no rows."""
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = some.schema["doc_id"].dataType.simpleString()
    shared = some.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 400):
                part = b.slice(at, 400)
                texts = part.column("text").to_pylist()
                coded = m.encode(texts)
                same = [m.decode(c) == (t or "").replace(SPACE, " ") for c, t in zip(coded, texts)]
                offsets = np.concatenate(([0], np.cumsum([len(c) // 4 for c in coded]))).astype(np.int32)
                flat = np.frombuffer(b"".join(coded), "<i4")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(same), pa.array([hashlib.sha256(c).hexdigest() for c in coded])],
                    names=["doc_id", "n_tokens", "ids", "round_trip", "ids_sha256"],
                )

    return some.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean, ids_sha256 string")


def decode(coded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text for each row of ids; null ids give null, no ids the empty text."""
    some = coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = some.schema["doc_id"].dataType.simpleString()
    shared = some.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(shared.value)
        for b in batches:
            texts = [None if not v.is_valid else m.decode(v.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes()) for v in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return some.mapInArrow(run, f"doc_id {kind}, text string")
