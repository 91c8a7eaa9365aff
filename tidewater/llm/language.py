"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

A word's probability in a language is the sum, over all its segmentations into vocabulary pieces,
of the product of the pieces' probabilities; one forward pass over the whole word adds them up. A
text's score is the product over its words, since pieces never cross words. Piece probabilities
come from a few rounds of expectation maximisation on the word counts of a bounded sample of
labelled documents.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import held, importable, neutral, tidy
from tidewater.llm.lookup import LETTER, ODD, Keys, WordTable

UNKNOWN = "und"
#: Labelled documents in the training sample (about), word types that training looks at, and its rounds.
SAMPLE, TYPES, ROUNDS = 4000, 40_000, 3
#: Words that a worker's table may hold before it drops those met once, and numbers in their scores.
TABLE, NUMBERS = 300_000, 8_000_000
#: Bytes after which a forward pass takes a common factor out of its sums, and of words that are summed one by one.
RESCALE, ALONE = 16, 256
#: Letters after which training, not prediction, begins a new word.
TRAINED = 64
_WORD = re.compile(r"[^\W\d_]+")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(path: str) -> list[bytes]:
    """The vocabulary's plain pieces, lower-cased, as UTF-8 with a space for a word's begin; and every byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            piece = model.id_to_piece(i).replace("▁", " ").lower().encode()
            if piece.strip() and b" " not in piece[1:]:
                found.add(piece)
    return sorted(found)


class Lexicon:
    """The pieces as a tree of bytes in arrays: `step` goes from node to node, `piece` has the piece that ends there or -1."""

    def __init__(self, vocabulary: list[bytes]):
        steps: dict[int, int] = {}
        ends = {0: -1}
        for number, p in enumerate(vocabulary):
            node = 0
            for byte in p:
                node = steps.setdefault(node << 8 | byte, len(steps) + 1)
            ends[node] = number
        self.steps = Keys(np.fromiter(steps.keys(), np.int64, len(steps)), np.fromiter(steps.values(), np.int64, len(steps)), 0)
        self.piece = np.full(len(steps) + 1, -1, dtype=np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.size = len(vocabulary)
        self.longest = max(map(len, vocabulary))

    def met(self, rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, rows, pieces) for all pieces in a matrix of equally long words, by begin and end; (begin, begin, ..) opens each begin."""
        n, width = rows.shape
        none = np.empty(0, np.int64)
        for begin in range(width):
            yield begin, begin, none, none
            live, node = np.arange(n), np.zeros(n, dtype=np.int64)
            for end in range(begin + 1, min(width, begin + self.longest) + 1):
                node = self.steps.find(node << 8 | rows[live, end - 1])
                on = np.flatnonzero(node)
                if not len(on):
                    break
                live, node = live[on], node[on].astype(np.int64)
                piece = self.piece[node]
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    yield begin, end, live[hit], piece[hit]


def stretches(words: list[bytes], cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words with their begin mark as byte matrices of equal width: (owner, bytes), of about `cells` bytes or one word."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for width, owner in by.items():
        step = max(1, cells // (width + 1))
        for lo in range(0, len(owner), step):
            part = owner[lo : lo + step]
            raw = b"".join(b" " + words[i] for i in part)
            yield np.array(part), np.frombuffer(raw, np.uint8).reshape(len(part), width + 1)


def forward(rows: np.ndarray, lexicon: Lexicon, table: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all segmentations of each whole row, (row, language).

    Only the sums that a piece can still reach are held, so a word of any length takes the memory of
    the longest piece.
    """
    n, width = rows.shape
    ring = lexicon.longest + 1
    sums = np.zeros((ring, n, table.shape[1]))
    sums[0] = 1
    scale = np.zeros(sums.shape[1:])
    now = None
    for begin, end, who, piece in lexicon.met(rows):
        if begin == end:
            if now is not None:
                sums[(begin - 1) % ring] = 0
            now = sums[begin % ring]
            if begin % RESCALE == 0 and begin:
                factor = now.copy()
                scale += np.log(factor)
                sums /= factor
                now = sums[begin % ring]
        else:
            sums[end % ring, who] += now[who] * table[piece]
    return scale + np.log(sums[width % ring])


def forward_alone(raw: np.ndarray, lexicon: Lexicon, table: np.ndarray) -> np.ndarray:
    """As forward for one long row: its pieces are found at all places at once, then summed up in order."""
    n = len(raw)
    live, node = np.arange(n), np.zeros(n, dtype=np.int64)
    found = []
    for k in range(lexicon.longest):
        node = lexicon.steps.find(node << 8 | raw[live + k])
        on = np.flatnonzero(node)
        live, node = live[on], node[on].astype(np.int64)
        hit = np.flatnonzero(lexicon.piece[node] >= 0)
        found.append((live[hit], live[hit] + k + 1, lexicon.piece[node[hit]]))
        go = live + k + 1 < n
        live, node = live[go], node[go]
    begin, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(begin, kind="stable")
    begins, ends = begin[order].tolist(), end[order].tolist()
    out = np.zeros(table.shape[1])
    for k in range(table.shape[1]):
        sums, scale, mark = [1.0] + [0.0] * n, 0.0, RESCALE
        for b, e, p in zip(begins, ends, table[piece[order], k].tolist(), strict=True):
            if b >= mark:
                factor = sums[b]
                scale += math.log(factor)
                for j in range(b, min(n, b + lexicon.longest) + 1):
                    sums[j] /= factor
                mark = b + RESCALE
            sums[e] += sums[b] * p
        out[k] = scale + math.log(sums[n])
    return out


def word_scores(words: list[bytes], lexicon: Lexicon, table: np.ndarray) -> np.ndarray:
    """Logarithms of the probabilities of words in lower case, as UTF-8, (word, language)."""
    langs = table.shape[1]
    out = np.zeros((len(words), langs))
    for owner, rows in stretches(words, max(1, 200_000 // langs)):
        if rows.shape[1] > ALONE:
            for i, raw in zip(owner, rows, strict=True):
                out[i] = forward_alone(raw, lexicon, table)
        else:
            out[owner] = forward(rows, lexicon, table)
    return out


def train(counts: dict[bytes, np.ndarray], lexicon: Lexicon, langs: int, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (piece, language) by expectation maximisation in logarithms; every piece keeps a little."""
    words = sorted(counts)
    weight = np.array([counts[w] for w in words], dtype=np.float64).reshape(len(words), langs)
    table = np.full((lexicon.size, langs), 1.0 / lexicon.size)
    for _ in range(rounds):
        used = np.full((lexicon.size, langs), 0.05)
        log = np.log(table)
        for owner, rows in stretches(words, max(1, 400_000 // langs)):
            width = rows.shape[1]
            fore = np.full((width + 1, len(rows), langs), -np.inf)
            back = fore.copy()
            fore[0] = back[width] = 0
            met = [m for m in lexicon.met(rows) if m[0] < m[1]]
            for begin, end, who, piece in met:
                fore[end, who] = np.logaddexp(fore[end, who], fore[begin, who] + log[piece])
            for begin, end, who, piece in reversed(met):
                back[begin, who] = np.logaddexp(back[begin, who], back[end, who] + log[piece])
            whole = np.log(np.maximum(weight[owner], 1e-300)) - fore[width]
            for begin, end, who, piece in met:
                np.add.at(used, piece, np.exp(fore[begin, who] + log[piece] + back[end, who] + whole[who]))
        table = used / used.sum(axis=0)
    return table


class Words:
    """A worker's table of words (lower case) and odd chunks: log-probabilities by language, and how many words."""

    def __init__(self, langs: list[str], prior: np.ndarray, table: np.ndarray, lexicon: Lexicon):
        self.langs, self.prior, self.probs, self.lexicon = langs, prior, table, lexicon
        self.rows = np.zeros((0, len(langs) + 1))
        self.used = 0
        self.table = WordTable(self._learn, self._restart, max(256, min(TABLE, NUMBERS // (len(langs) + 1))))

    def _restart(self, kept: np.ndarray) -> None:
        self.rows, self.used = self.rows[kept], len(kept)

    def _learn(self, text: np.ndarray, b: np.ndarray, e: np.ndarray, odd: np.ndarray) -> int:
        raw = memoryview(text)
        found: list[bytes] = []
        count = []
        for x, y, o in zip(b.tolist(), e.tolist(), odd.tolist(), strict=True):
            if o:
                own = [w for w in _WORD.findall(bytes(raw[x:y]).decode("utf-8", "replace").lower()) if any(map(str.isalpha, w))]
                found += [w.encode("utf-8", "replace") for w in own]
                count.append(len(own))
            else:
                found.append(bytes(raw[x:y]))
                count.append(1)
        each = word_scores(found, self.lexicon, self.probs)
        base, n = self.used, len(count)
        if base + n > len(self.rows):
            self.rows = np.concatenate((self.rows[:base], np.zeros((max(n, base // 2, 1 << 12), self.rows.shape[1]))))
        np.add.at(self.rows[base : base + n, :-1], np.repeat(np.arange(n), count), each)
        self.rows[base : base + n, -1] = count
        self.used += n
        return base

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """The most probable language of each text and its posterior; UNKNOWN and 0 without letters or languages."""
        if not self.langs:
            return [UNKNOWN] * len(column), np.zeros(len(column))
        names: list[str] = []
        scores = []
        step = max(1, NUMBERS // (len(self.langs) + 1))
        for lo in range(0, len(column), step):
            part = column.slice(lo, step)
            total = np.zeros((len(part), len(self.langs) + 1))
            for row, owner, numbers in self.table.look_up(part, (LETTER, ODD)):
                if len(owner):
                    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                    total[row + owner[first]] += np.add.reduceat(self.rows[numbers], first, axis=0)
            logs = self.prior + total[:, :-1]
            best = logs.argmax(axis=1)
            known = total[:, -1] > 0
            score = 1.0 / np.exp(logs - logs[np.arange(len(best)), best][:, None]).sum(axis=1)
            names += [self.langs[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)]
            scores.append(np.where(known, np.minimum(score, 1.0), 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def held_out(key: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", path: str | None = None, sample: int = SAMPLE):
    """(languages, log priors, piece probabilities, lexicon) from labelled documents that aren't held out.

    About `sample` documents, equally many of each language while it has them, chosen by a hash of
    the key; of these, the TYPES most frequent words, equally many of each language, runs of over
    TRAINED letters cut. The bounds hold at any size of the input. The model takes pieces x languages numbers.
    """
    labelled = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").cast("string").alias("l"))
    labelled = labelled.where(F.col("l").isNotNull() & ~held_out("k"))
    counts = sorted((r["l"], r["count"]) for r in labelled.groupBy("l").count().collect())  # a row for each language
    lexicon = Lexicon(pieces(path or model_path()))
    if not counts:
        return [], np.zeros(0), np.zeros((0, 0)), lexicon
    each = max(1, sample // len(counts))
    shares = df.sparkSession.createDataFrame([(name, min(1.0, each / n)) for name, n in counts], "_l string, share double")
    if len(counts) <= 10_000:
        shares = F.broadcast(shares)
    drawn = labelled.join(shares, F.col("l") == F.col("_l")).where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    words = drawn.select("l", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(f"\\p{{L}}{{1,{TRAINED}}}"), F.lit(0))).alias("w"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("count"), "w"))
    top = words.groupBy("l", "w").count().withColumn("rank", rank).where(F.col("rank") <= max(1, TYPES // len(counts)))
    place = {name: i for i, (name, _) in enumerate(counts)}
    by_word: dict[bytes, np.ndarray] = {}
    for r in top.collect():  # at most TYPES rows, or one for each language
        by_word.setdefault(r["w"].encode("utf-8", "replace"), np.zeros(len(counts)))[place[r["l"]]] += r["count"]
    prior = np.log(np.array([n for _, n in counts], dtype=np.float64))
    return [name for name, _ in counts], prior - prior.max(), train(by_word, lexicon, len(counts)), lexicon


def predict(df: DataFrame, model, text: str = "text") -> DataFrame:
    """df's rows with lang_pred and score added, columns of these names replaced; see identify."""
    importable(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # pieces x languages
    token = uuid.uuid4().hex

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(f"words {token}", lambda: Words(*shared.value))
        for b in batches:
            names, scores = words.predict(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])

    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("lang_pred", "score")]
    fields = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)
    return df.select(*keep, F.col(f"`{text}`").alias("_text_of_prediction")).mapInArrow(run, f"{fields}, lang_pred string, score double")


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", path: str | None = None) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one per row of df.

    Learns from texts and non-null labels of rows whose crc32(key as text) mod 5 is not 0 (a null
    key counts as the empty text, so it is held out), and predicts every whole text from the text
    alone; a very long one in stretches. Texts that are null or have no letter are `und` with score
    0, as all are where no row is labelled. The score is the posterior of the predicted language.
    Repeated rows are predicted each; other columns of df are ignored; an empty df gives no rows.
    """
    model = fit(df, key, text, lang, path)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), held_out(f"`{key}`").alias("held_out"), F.col(f"`{text}`").alias("text"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def drop_unknown(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", path: str | None = None) -> DataFrame:
    """df without the rows whose text is null or has no letter, so that it is in no language; all its columns.

    A null label of a row that stays is filled in with the predicted language; given labels are left
    as they are. Without any labels there is nothing to learn from: rows with letters stay as they
    are. Repeated rows are judged each; an empty df gives no rows.
    """
    plain, names = neutral(df)
    model = fit(plain, names[key], names[text], names[lang], path)
    if not model[0]:
        seen = plain.where(F.col(names[text]).rlike("\\p{L}"))
        return seen.select(*[F.col(n).alias(c) for c, n in names.items()])
    seen = predict(plain, model, names[text]).where(F.col("lang_pred") != UNKNOWN)
    filled = {names[lang]: F.coalesce(F.col(names[lang]), F.col("lang_pred").cast(plain.schema[names[lang]].dataType))}
    return seen.select(*[filled.get(n, F.col(n)).alias(c) for c, n in names.items()])
