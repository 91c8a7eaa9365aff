"""Token counts and ids of the public word BPE, with a whole-token shortcut.

Nothing in that vocabulary's normaliser, pattern, special strings or merges reaches over white
space, so a text's tokens are those of its pre-tokens in a row. Pre-tokens are found with numpy and
looked up in a table, which begins with the strings that were proved, once and on the driver, to
encode alone as one token; the rest are merged, many at a time. On printable ASCII and U+00C0 to
U+017F lower case, composition and classes are those of the library; a chunk between white space
with any other character is normalised and split by the library, the chunk alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm.common import held, importable, tidy
from tidewater.llm.lookup import ODD, WIDTH, Keys, WordTable, ragged
from tidewater.llm.lookup import pieces as split

LIMIT = 2048
#: Pieces that a worker's table may hold before it drops those met once, and ids in all of them.
TABLE, IDS = 400_000, 8_000_000
#: Bytes of the longest pre-token that is merged in arrays, and the fewest of one length that are.
LONG, FEW = 64, 12
#: The normaliser and the pattern for which chunks are proved independent.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """What workers need of a vocabulary file: made and proved once, on the driver, and shipped.

    `whole` has the strings that the library's merges, run on them alone, bring to one token.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, normal, split = made["model"], made["normalizer"] or {}, made["pre_tokenizer"] or {}
        steps = split.get("pretokenizers", [{}])
        if (
            model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or made["post_processor"] or len(model["vocab"]) > 65536
            or [n["type"] for n in normal.get("normalizers", [])] != _NORMAL or steps[0].get("pattern") != {"Regex": _PATTERN}
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"])
        ):
            raise ValueError(f"{path} is not a word BPE of the kind whose chunks are proved independent")
        self.path = path
        self.specials = [t["content"] for t in made["added_tokens"]]
        ids = model["vocab"]
        letters = _byte_letters()
        self.single = np.array([ids[c] for c in letters], dtype=np.int32)
        self.last = np.array([ids[c + "</w>"] for c in letters], dtype=np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        self.never = len(pairs)
        self.ranks = Keys(np.array([ids[a] << 16 | ids[b] for a, b in pairs]), np.arange(len(pairs)), self.never)
        library = Tokenizer.from_file(path).model
        back = {c: b for b, c in enumerate(letters)}
        self.whole: dict[bytes, int] = {}
        for entry, number in ids.items():
            spelled = entry[:-4] if entry.endswith("</w>") else ""
            got = library.tokenize(spelled) if spelled and all(c in back for c in spelled) else []
            if len(got) == 1 and got[0].id == number:
                self.whole[bytes(back[c] for c in spelled)] = number


def _alone(found: list[bytes], low: np.ndarray, b: np.ndarray, e: np.ndarray, kind: np.ndarray) -> list[bool]:
    """Which strings are one piece each, in lower case and not odd, given the pieces of all of them on lines."""
    raw, there = low.tobytes(), set()
    for x, y, k in zip(b.tolist(), e.tolist(), kind.tolist(), strict=True):
        if k != ODD and (x == 0 or raw[x - 1] == 10) and (y == len(raw) or raw[y] == 10):
            there.add(raw[x:y])
    return [w in there for w in found]


class Chunks:
    """A worker's table of pieces and their ids, unsigned 16-bit numbers."""

    def __init__(self, vocabulary: Vocabulary, limit: int = TABLE):
        self.v = vocabulary
        self.letters = _byte_letters()
        self.back = {c: b for b, c in enumerate(self.letters)}
        self.table = WordTable(self._learn, self._restart, limit)
        self.at, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint16)
        self.used = self.held = 0
        # Whole tokens of up to WIDTH bytes that are pieces as they stand: known from the start.
        short = [w for w in self.v.whole if len(w) <= WIDTH][: limit // 4]
        joined = np.frombuffer(b"\n".join(short), np.uint8)
        low, b, e, kind, _ = split(joined, np.array([0, len(joined)]))
        seeds = [w for w, good in zip(short, _alone(short, low, b, e, kind), strict=True) if good]
        self._append(np.array([self.v.whole[w] for w in seeds], dtype=np.uint16), np.ones(len(seeds), np.int64))
        self.table.seed(seeds)
        self._library: Tokenizer | None = None

    @property
    def library(self) -> Tokenizer:
        if self._library is None:
            self._library = Tokenizer.from_file(self.v.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def _append(self, ids: np.ndarray, n: np.ndarray) -> int:
        """Adds entries with their ids to the pool; the number of the first."""
        base = self.held
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.empty(max(len(ids), self.used // 2, 1 << 16), np.uint16)))
        if base + len(n) > len(self.n):
            more = np.zeros(max(len(n), base // 2, 1 << 14), np.int64)
            self.at, self.n = np.concatenate((self.at[:base], more)), np.concatenate((self.n[:base], more))
        self.at[base : base + len(n)] = self.used + np.cumsum(n) - n
        self.n[base : base + len(n)] = n
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.held += len(n)
        if self.used > IDS:
            self.table.held = self.table.limit  # a new beginning before the next lookup
        return base

    def _restart(self, kept: np.ndarray) -> None:
        n = self.n[kept]
        pool = ragged(self.pool, self.at[kept], n)
        self.pool, self.n, self.at = pool, n, np.cumsum(n) - n
        self.used, self.held = len(pool), len(kept)

    def _learn(self, text: np.ndarray, b: np.ndarray, e: np.ndarray, odd: np.ndarray) -> int:
        flat, n = self.merge(text, b, np.where(odd, b, e))
        at = np.flatnonzero(odd)
        if not len(at):
            return self._append(flat, n)
        raw = memoryview(text)
        own = [self._left_over(bytes(raw[x:y])) for x, y in zip(b[at].tolist(), e[at].tolist(), strict=True)]
        place = np.cumsum(n) - n
        place[at] = len(flat) + np.cumsum([0, *map(len, own)])[:-1]
        n[at] = [len(x) for x in own]
        return self._append(ragged(np.concatenate((flat, np.array([i for x in own for i in x], dtype=np.uint16))), place, n), n)

    def _left_over(self, chunk: bytes) -> list[int]:
        """Ids of a chunk that the library must normalise and split; its pre-tokens still take the shortcut."""
        text = chunk.decode()
        if any(s in text for s in self.v.specials):
            return self.library.encode(text, add_special_tokens=False).ids
        ids: list[int] = []
        for spelled, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)):
            number = self.v.whole.get(bytes(map(self.back.__getitem__, spelled)))
            ids += [number] if number is not None else [t.id for t in self.library.model.tokenize(spelled)]
        return ids

    def merge(self, text: np.ndarray, b: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens text[b:e] in a row, and how many each has; none for an empty one."""
        width = e - b
        n = np.zeros(len(b), dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(width, kind="stable")
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(width[order])) + 1, [len(order)]))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            group = order[lo:hi]
            w = int(width[group[0]]) if len(group) else 0
            if not w:
                continue
            if w > LONG or (len(group) < FEW and w > 1):
                for i in group.tolist():
                    piece = text[b[i] : e[i]].tobytes()
                    got = [t.id for t in self.library.model.tokenize("".join(map(self.letters.__getitem__, piece)))]
                    done.append((np.array([i]), np.array([got], dtype=np.int32)))
                continue
            step = max(1, 60_000 // w)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                done += self._merge_equally_long(part, text[b[part][:, None] + np.arange(w)])
        for who, ids in done:
            n[who] = ids.shape[1]
        at = np.cumsum(n) - n
        flat = np.empty(int(n.sum()), dtype=np.uint16)
        for who, ids in done:
            flat[at[who][:, None] + np.arange(ids.shape[1])] = ids
        return flat, n

    def _merge_equally_long(self, who: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merges the pair of lowest rank, the first of equals, in every row until none is left; rows shorten alike."""
        v = self.v
        pair = lambda a, b: v.ranks.find(a.astype(np.int64) << 16 | b)
        ids = v.single[rows]
        ids[:, -1] = v.last[rows[:, -1]]
        rank = pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(who), -1)
        while len(who):
            width = ids.shape[1]
            if width == 1:
                yield who, ids
                return
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(who)), at]
            over = best == v.never
            if over.any():
                yield who[over], ids[over]
                go = ~over
                who, ids, rank, at, best = who[go], ids[go], rank[go], at[go], best[go]
            every = np.arange(len(who))
            before = np.arange(width - 1) <= at[:, None]
            ids = np.where(before, ids[:, :-1], ids[:, 1:])
            ids[every, at] = v.merged[best]
            rank = np.where(before[:, : width - 2], rank[:, : width - 2], rank[:, 1:])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = pair(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < width - 2)
            rank[right, at[right]] = pair(ids[right, at[right]], ids[right, at[right] + 1])

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text, none for null."""
        out = np.zeros(len(column), dtype=np.int64)
        for row, owner, numbers in self.table.look_up(column):
            if len(owner):
                sums = np.bincount(owner, weights=self.n[numbers]).astype(np.int64)
                out[row : row + len(sums)] += sums
        return out

    def ids(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text as unsigned 16-bit numbers, none for null."""
        none = np.empty(0, dtype=np.uint16)
        out = [none] * len(column)
        for row, owner, numbers in self.table.look_up(column):
            if not len(owner):
                continue
            n = self.n[numbers]
            flat = ragged(self.pool, self.at[numbers], n)
            cuts = np.concatenate(([0], np.cumsum(np.bincount(owner, weights=n).astype(np.int64))))
            for i in range(len(cuts) - 1):
                if cuts[i + 1] > cuts[i]:
                    part = flat[cuts[i] : cuts[i + 1]]
                    out[row + i] = part if not len(out[row + i]) else np.concatenate((out[row + i], part))
        return out


_proved: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """A vocabulary file, read and proved once in this process."""
    if path not in _proved:
        _proved.clear()
        _proved[path] = Vocabulary(path)
    return _proved[path]


def shipped(spark, path: str) -> Callable[[], Chunks]:
    """Proves the vocabulary here and ships it; gives a function that makes or finds a worker's table."""
    sent = spark.sparkContext.broadcast(vocabulary(path))  # 49,408 entries
    return lambda: held(f"chunks {path}", lambda: Chunks(sent.value))


def count_tokens(df: DataFrame, path: str | None = None, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one per row of df, without any shuffle.

    Counts are the library's for the whole text without added tokens; null counts as empty: 0
    bytes, 0 tokens. Other columns of df are ignored and repeated rows are counted each; an empty
    df gives no rows. A very long text is counted in stretches, so memory is an Arrow batch of texts
    and a table of at most TABLE chunks and IDS ids a worker.
    """
    importable(df.sparkSession)
    made = shipped(df.sparkSession, path or vocabulary_path())

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = made()
        for b in batches:
            n = table.counts(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("body"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
