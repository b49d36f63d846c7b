"""Byte-level BPE by corpus-level merge replay (operator 1).

``encode`` cuts every text with the tokenizer's pattern, gathers the distinct pieces of a block of texts that the
worker has not met yet, and replays the merges over that whole word list at once: an inverted index maps a merge to
the positions where its pair stands, merges are taken in rank order, and each application touches only the two
neighbouring pairs. Texts are then spelled from the finished word list. ``decode`` maps ids back to bytes.

Defined results: null and empty texts give no ids and decode to no bytes; a text of any length, with or
without white space, is one sequence; repeated rows repeat their result; an empty table gives an empty
table; columns that clash with the output names are replaced."""

from __future__ import annotations

import base64
import gc
import heapq
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, read_table, texts

#: A worker forgets what it has spelled once its tables hold so many bytes, ENTRY of them for each entry's own
#: overhead; so they are bounded by this and what one block adds.
HELD, ENTRY = 80 << 20, 200
#: Characters of a block of texts, whose new words go through one replay; bytes of a kernel's slice of rows.
SLICE = 8_000_000
#: The pattern under which texts may be cut at blanks (fixed value, as the tokenizer publishes it).
BLANK_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank that cannot open a piece of its own: white space or the end follows it.
LOOSE_BLANK = re.compile(r" (?:\s|\Z)")


def read_ranks(path: str) -> list[bytes]:
    """The token bytes by id from a rank file (base64 token and id per line)."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (max(int(i) for _, i in pairs) + 1)
    for token, i in pairs:
        tokens[int(i)] = base64.b64decode(token)
    return tokens


class MergeReplay:
    """Encodes lists of words together by replaying the merges in rank order over an inverted index.

    The words' symbols stand in flat arrays linked to their neighbours; ``index`` maps a merge, known by the
    id it makes, to the positions where its pair begins; a merge is applied to all of them in array
    operations, or one by one where its pairs overlap."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        # every way to cut a token into two tokens, by (left << 32 | right)
        cuts = [(self.rank[t[:k]] << 32 | self.rank[t[k:]], i) for t, i in self.rank.items() for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank]
        pairs = np.array(sorted(cuts), np.int64).reshape(-1, 2)
        self.pair, self.made = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids of the tokens that a followed by b spell, or -1."""
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
        return np.where(self.pair[at] == code, self.made[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        out = [b""] * len(words)
        todo = []
        for w, word in enumerate(words):
            if (r := self.rank.get(word)) is not None:
                out[w] = r.to_bytes(4, "little")
            elif word:
                todo.append(w)
        if todo:
            ids, counts, strayed = self.replay([words[w] for w in todo])
            flat, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(counts)).tolist()
            start = 0
            for w, end in zip(todo, ends, strict=True):
                out[w] = flat[start:end]
                start = end
            for k in strayed:
                out[todo[k]] = np.array(self.encode_one(words[todo[k]]), "<i4").tobytes()
        return out

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, set[int]]:
        """The ids of all words in a row, the number of each, and the words in which a merge opened one of
        lower rank, so that the order over the corpus is not the word's own."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        n, ends = len(symbol), np.cumsum(sizes)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = before[ends - sizes] = -1
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        made = np.full(n, -1, np.int32)  # by position, the merge that its pair would be
        first = np.flatnonzero(after >= 0).astype(np.int32)
        made[first] = self.merged(symbol[first], symbol[first + 1])
        index: dict[int, list[np.ndarray]] = {}
        due: list[int] = []

        def enter(merges: np.ndarray, places: np.ndarray) -> None:
            """Add places to the index under the merges that their pairs would be."""
            order = np.argsort(merges, kind="stable")
            merges, places = merges[order], places[order]
            at = np.flatnonzero(merges[1:] != merges[:-1]) + 1
            for r, x in zip(merges[np.concatenate([[0], at])].tolist(), np.split(places, at) if len(at) else [places], strict=True):
                if r in index:
                    index[r].append(x)
                else:
                    index[r] = [x]
                    heapq.heappush(due, r)

        first = first[made[first] >= 0]
        if len(first):
            enter(made[first], first)
        strayed: set[int] = set()
        while due:
            r = heapq.heappop(due)
            places = index.pop(r)
            p = places[0] if len(places) == 1 else np.unique(np.concatenate(places))
            p = p[made[p] == r]
            if not len(p):
                continue
            overlap = len(p) > 1 and (after[p[:-1]] == p[1:]).any()  # then leftmost first
            for p in [p[i : i + 1] for i in range(len(p))] if overlap else [p]:
                p = p[made[p] == r] if overlap else p
                if not len(p):
                    continue
                q = after[p]
                z = after[q]
                symbol[p], symbol[q], made[q], made[p], after[p] = r, -1, -1, -1, z
                right = z >= 0
                before[z[right]] = p[right]
                b = before[p]
                starts = np.concatenate([b[b >= 0], p[right]])
                if not len(starts):
                    continue
                made[starts] = new = self.merged(symbol[starts], symbol[after[starts]])
                some = new >= 0
                if some.any():
                    new, starts = new[some], starts[some]
                    if (new < r).any():
                        strayed.update(word_of[starts[new < r]].tolist())
                    if len(new) == 1:
                        if (s := int(new[0])) in index:
                            index[s].append(starts)
                        else:
                            index[s] = [starts]
                            heapq.heappush(due, s)
                    else:
                        enter(new, starts)
        alive = symbol >= 0
        return symbol[alive], np.bincount(word_of[alive], minlength=len(words)), strayed

    def encode_one(self, word: bytes) -> list[int]:
        """One word with its merges in its own order of rank, leftmost first."""
        parts = [int(self.byte[b]) for b in word]
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        spell = lambda a, b: self.rank.get(self.tokens[parts[a]] + self.tokens[parts[b]], -1) if a >= 0 and b >= 0 and parts[a] >= 0 else -1
        due = [(r, p) for p in range(len(parts)) if (r := spell(p, after[p])) >= 0]
        heapq.heapify(due)
        while due:
            r, p = heapq.heappop(due)
            q = after[p]
            if spell(p, q) != r:
                continue
            parts[p], parts[q] = r, -1
            after[p] = z = after[q]
            if z >= 0:
                before[z] = p
            for left, right in ((before[p], p), (p, z)):
                if (s := spell(left, right)) >= 0:
                    heapq.heappush(due, (s, left))
        return [s for s in parts if s >= 0]


class Speller:
    """Spells texts as little-endian 32-bit ids from a growing table of pieces.

    Under BLANK_PATTERN a blank followed by anything but white space always opens a new piece, so a text may be cut
    there and each distinct chunk handled once: ``lead`` holds chunks at a text's start, ``rest`` those that follow a
    blank. Under any other pattern a text is cut by the pattern alone. ``words`` holds the pattern's pieces."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex

        self.find = regex.compile(pattern).finditer
        self.by_blank = pattern == BLANK_PATTERN
        self.replay = MergeReplay(tokens)
        self.forget()

    def forget(self) -> None:
        self.lead: dict[str, bytes] = {"": b""}
        self.rest: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    def split(self, text: str) -> list[str]:
        """The pattern's whole matches, whatever groups it has."""
        return [m[0] for m in self.find(text)]

    @staticmethod
    def chunks(text: str) -> list[str]:
        parts = text.split(" ")
        if not LOOSE_BLANK.search(text):
            return parts
        out = parts[:1]
        for part in parts[1:]:
            if not part or part[0].isspace():
                out[-1] = f"{out[-1]} {part}"
            else:
                out.append(part)
        return out

    def pieces(self, chunk: str) -> list[str]:
        """The pattern's matches in a chunk with its blank; most are letters with one mark at the end."""
        if chunk.isalpha():
            return [" " + chunk]
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return [" " + chunk[:-1], chunk[-1]]
        return self.split(" " + chunk)

    def add(self, table: dict[str, bytes], keys: list[str], spelled: list[bytes]) -> None:
        table.update(zip(keys, spelled, strict=True))
        self.held += sum(map(len, keys)) + sum(map(len, spelled)) + ENTRY * len(keys)

    def learn(self, lead: list[str], rest: list[str]) -> None:
        """Replay the merges over the words of new chunks that no chunk had before."""
        cut = [*map(self.split, lead), *map(self.pieces, rest)]
        new = list({w for ws in cut for w in ws}.difference(self.words))
        self.add(self.words, new, self.replay.encode([w.encode() for w in new]))
        spelled = self.words.__getitem__
        joined = [spelled(ws[0]) if len(ws) == 1 else b"".join(map(spelled, ws)) for ws in cut]
        self.add(self.lead, lead, joined[: len(lead)])
        self.add(self.rest, rest, joined[len(lead) :])

    def __call__(self, batch: list[str]) -> list[bytes]:
        gc.disable()  # millions of short-lived strings and no cycles
        try:
            out: list[bytes] = []
            at, size = 0, 0
            for end, text in enumerate(batch, 1):
                size += len(text)
                if size >= SLICE or end == len(batch):
                    out.extend(self.spell(batch[at:end]))
                    at, size = end, 0
                    if self.held > HELD:
                        self.forget()
            return out
        finally:
            gc.enable()

    def spell(self, block: list[str]) -> list[bytes]:
        """One block of texts: its word list first, then the texts from it."""
        if not self.by_blank:
            new = {w for t in block for w in self.split(t)}.difference(self.words)
            self.add(self.words, list(new), self.replay.encode([w.encode() for w in new]))
            return [b"".join([self.words[w] for w in self.split(t)]) for t in block]
        lead, rest = set(), set()
        for t in block:
            cut = self.chunks(t)
            lead.add(cut[0])
            del cut[0]
            rest.update(cut)
        lead.difference_update(self.lead)
        rest.difference_update(self.rest)
        if lead or rest:
            self.learn(list(lead), list(rest))
        del lead, rest
        return [b"".join([self.lead[cut[0]], *map(self.rest.__getitem__, cut[1:])]) for cut in map(self.chunks, block)]


#: The spellers of this worker process: tasks that follow one another go on with what was learnt.
SPELLERS: dict[tuple[str, str], Speller] = {}


def speller(ranks: str, pattern: str) -> Speller:
    if (ranks, pattern) not in SPELLERS:
        SPELLERS.clear()
        SPELLERS[ranks, pattern] = Speller(read_ranks(ranks), pattern)
    return SPELLERS[ranks, pattern]


def encode(df: DataFrame, ranks: str, pattern: str, text_col: str = "text", out_col: str = "token_ids", drop_text: bool = False) -> DataFrame:
    """``df`` with ``out_col`` array<int>: the ids of each text by the rank file ``ranks``, each match of
    ``pattern`` encoded separately, no special tokens."""

    def make() -> Callable:
        spell = speller(ranks, pattern)

        def kernel(column: pa.Array) -> list:
            ids = spell(texts(column))
            ends = np.cumsum([0, *(len(b) // 4 for b in ids)])
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]

        return kernel

    return add_columns(df, text_col, T.StructType([T.StructField(out_col, T.ArrayType(T.IntegerType()))]), make, drop_source=drop_text, size=SLICE)


def decode(df: DataFrame, ranks: str, ids_col: str = "token_ids", out_col: str = "decoded", drop_ids: bool = False) -> DataFrame:
    """``df`` with ``out_col`` binary: the bytes the ids stand for (null ids: empty). Ids are ranks of the
    file; others raise."""

    def make() -> Callable:
        token = read_ranks(ranks).__getitem__

        def kernel(column: pa.Array) -> list:
            spans = column.offsets.to_numpy()
            base = int(spans[0]) if len(spans) else 0
            values = column.flatten().to_numpy(zero_copy_only=False)
            return [pa.array([b"".join(map(token, values[a - base : b - base].tolist())) for a, b in zip(spans[:-1], spans[1:], strict=True)], pa.binary())]

        return kernel

    return add_columns(df, ids_col, T.StructType([T.StructField(out_col, T.BinaryType())]), make, drop_source=drop_ids)


def digest(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per document: number of ids and digests of the ids and of the decoded bytes."""
    ids = encode(docs.select("doc_id", "text"), ranks, pattern, drop_text=True)
    spelled = F.concat_ws(" ", F.col("token_ids").cast("array<string>"))
    counted = ids.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(spelled, 256).alias("ids_sha256"), "token_ids")
    return decode(counted, ranks, drop_ids=True).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return digest(read_table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)

