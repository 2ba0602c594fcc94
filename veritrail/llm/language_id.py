"""Language identification by unigrams over pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. Each language has a probability for every piece; a word's probability
in a language is the sum over all ways to cut it into pieces of the product of their probabilities, found by a forward
pass over all pieces and the whole word, however long. The piece probabilities are fitted by expectation-maximisation: a forward and a backward pass over the training
words give the expected count of every piece under all segmentations, in tasks; the driver only sees the table of
(language, piece) sums, as long as the vocabulary. Letters outside the vocabulary stand as pieces of their own that
share one small probability, so every word has a score. The sums of long words carry powers of two, so none becomes 0.

The fit takes whole texts of at most about ``per_language`` documents of a language, chosen by a hash of the key (all
documents where there are fewer); languages are the non-null labels among the training rows. Prediction takes nothing
but the text: the language with the largest total log probability of the text's words (runs of letters, lower case),
ties to the first in alphabetical order, and as ``score`` its share when every language has the weight
``exp(log probability / sqrt(letters))``. Texts that are null or without a letter, and all texts where nothing was
learned, give ``und`` and score 0.

Repeated rows each get their answer. Other columns pass through; ones named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.llm.common import fold, prepare

UNKNOWN = "und"
PER_LANGUAGE = 800  # documents of a language that the fit takes, about
ROUNDS = 3
START = "▁"  # marks the beginning of a word in the vocabulary
STRANGE = 1e-7  # probability of a letter that is no piece
MARKS = ".,;:!?\"'()[]"  # no letters; stand around words most often
AT_ONCE = 60_000  # tokens that are looked up together
TOKENS, WORDS = 200_000, 120_000  # that a worker remembers
WINDOW = 4_096  # characters of a long word that are looked up at once
CELLS = 1 << 18  # characters of words that are summed together
RESCALE = 8  # characters after which the sums over segmentations are brought back to about 1


class Pieces:
    """The pieces of letters, numbered from 1, and behind them the other beginnings of pieces, found by 64-bit hashes of
    their characters; 0 is neither."""

    BITS = 22

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = (model.id_to_piece(i) for i in range(model.get_piece_size())
                 if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
        self.names = sorted({p for p in names if p and all(c.isalpha() or c == START for c in p)})
        self.longest = max(map(len, self.names), default=1)
        begun = {name[:i] for name in self.names for i in range(1, len(name))}.difference(self.names)
        self.hashes = np.zeros(len(self.names) + len(begun) + 1, np.uint64)
        for i, name in enumerate([*self.names, *sorted(begun)], 1):
            value = np.zeros(1, np.uint64)
            for code in np.array([ord(c) for c in name], np.uint64):
                value = self.extend(value, code)
            self.hashes[i] = value[0]
        # several tables: what shares a place in one stands in the next
        self.tables: list[np.ndarray] = []
        rest = np.arange(1, len(self.hashes))
        while len(rest) or not self.tables:
            places = self._places(self.hashes[rest], len(self.tables))
            _, first = np.unique(places, return_index=True)
            self.tables.append(np.zeros(1 << self.BITS, np.int32))
            self.tables[-1][places[first]] = rest[first]
            rest = np.delete(rest, first)

    @staticmethod
    def extend(values: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The hashes of strings that are one character longer."""
        mixed = (values ^ codes.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return mixed ^ (mixed >> np.uint64(29))

    def _places(self, hashes: np.ndarray, table: int) -> np.ndarray:
        return ((hashes >> np.uint64(11 * table % 42)) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of the pieces and beginnings of pieces with these hashes."""
        number = self.tables[0][self._places(hashes, 0)]
        missed = np.flatnonzero(self.hashes[number] != hashes)
        for table in range(1, len(self.tables)):
            number[missed] = self.tables[table][self._places(hashes[missed], table)]
            missed = missed[self.hashes[number[missed]] != hashes[missed]]
        number[missed] = 0
        return number


@lru_cache(maxsize=2)
def piece_ids(path: str) -> Pieces:
    return Pieces(path)


def words_of(token: str) -> list[str]:
    """The runs of letters of a token in lower case."""
    bare = token.strip(MARKS)
    if bare.isalpha():
        return [bare.lower()]
    return "".join(c if c.isalpha() else " " for c in token).lower().split()


class Lattice:
    """All segmentations of words of one length (with the start mark), as piece numbers by end and piece length."""

    def __init__(self, words: list[str], pieces: Pieces):
        self.length, self.longest = len(words[0]), pieces.longest
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), self.length)
        self.piece: dict[tuple[int, int], np.ndarray] = {}  # by end and length; lengths beyond 1 only where there are any
        # all beginnings at once, size by size: place = beginning * words + word, so a beginning's places are neighbours
        letters = np.ascontiguousarray(codes.T).reshape(-1)
        place, value = np.arange(len(letters)), np.zeros(len(letters), np.uint64)
        for size in range(1, min(self.longest, self.length) + 1):
            inside = np.searchsorted(place, (self.length - size + 1) * len(words))
            place, value = place[:inside], value[:inside]
            value = Pieces.extend(value, letters[place + (size - 1) * len(words)])
            number = pieces.find(value)
            whole = (number > 0) & (number <= len(pieces.names))
            columns = np.zeros((self.length - size + 1, len(words)), np.int32)
            columns.reshape(-1)[place[whole]] = number[whole]
            for begin in range(len(columns)) if size == 1 else np.flatnonzero(columns.any(axis=1)).tolist():
                self.piece[(begin + size, size)] = columns[begin] if size == 1 else columns[begin].copy()
            place, value = place[number > 0], value[number > 0]  # others begin no longer piece
            if not len(place):
                break

    def _probability(self, span: tuple[int, int], table: np.ndarray) -> np.ndarray:
        """Languages' probabilities of the pieces in one place: words x languages."""
        found = table[self.piece[span]]
        if span[1] == 1:
            found = np.where(self.piece[span][:, None] == 0, STRANGE, found)
        return found

    def _summed(self, table: np.ndarray, ahead: bool, before: tuple | None = None) -> tuple[list[np.ndarray], list[np.ndarray | int], list]:
        """Sums of all places from one end of the words to the other, the powers of two that they are to be taken by, and
        the last sums, from which the next window of a long word goes on.

        After every ``RESCALE`` characters the sums still needed are divided by the power of two of the largest of them,
        so no sum becomes 0; in shorter words nothing is divided. ``before`` has the characters at the beginning that
        were summed already, their last sums and power."""
        length = self.length
        near = [np.ones((len(self.piece[(1, 1)]), table.shape[1]))]  # the last places, the nearest one first
        power: np.ndarray | int = 0
        done = 0
        if before is not None:
            done, near, power = before
        sums, powers = [near[0]], [power]
        for step in range(done + 1, length + 1):
            total = 0.0
            for size in range(1, min(self.longest, step) + 1):
                span = (step if ahead else length - step + size, size)
                if span in self.piece:
                    total = total + near[size - 1] * self._probability(span, table)
            near = [total, *near[:self.longest - 1]]
            if step % RESCALE == 0 and step < length:
                by = np.frexp(np.maximum.reduce(near))[1]
                near = [np.ldexp(n, -by) for n in near]
                power = power + by
            sums.append(near[0])
            powers.append(power)
        return (sums, powers, near) if ahead else (sums[::-1], powers[::-1], near)

    def forward(self, table: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray | int]]:
        """The summed probability of every beginning of the words, with its power of two."""
        return self._summed(table, True)[:2]

    def backward(self, table: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray | int]]:
        """The summed probability of every rest of the words, with its power of two."""
        return self._summed(table, False)[:2]

    def log_sums(self, table: np.ndarray) -> np.ndarray:
        """The log of the summed probability of the whole words."""
        sums, powers = self.forward(table)
        return np.log(sums[-1]) + powers[-1] * np.log(2.0)

    def expected(self, table: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers, and how often each is expected per language in words that stand there ``weight`` times."""
        (ahead, up), (behind, down) = self.forward(table), self.backward(table)
        long = self.length > RESCALE
        if long:  # halves to one, so that products of three stay far from 0
            (ahead, up), (behind, down) = ([list(x) for x in zip(*((m, p + e) for (m, e), p in zip(map(np.frexp, of), by)))]
                                           for of, by in ((ahead, up), (behind, down)))
        weight = weight / ahead[-1]
        found, shares = [np.zeros(0, int)], [np.zeros((0, table.shape[1]))]
        for (end, size), column in self.piece.items():
            if column.any():
                share = weight * ahead[end - size] * table[column] * behind[end]
                shares.append(np.ldexp(share, up[end - size] + down[end] - up[-1]) if long else share)
                found.append(column)
        return np.concatenate(found), np.concatenate(shares)


def long_log_sum(word: str, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """``Lattice.log_sums`` of one long word, window after window: the last sums of each go over into the next."""
    before, context = None, 0
    for start in range(0, len(word), WINDOW):
        context = min(start, pieces.longest - 1)
        if before is not None:
            before = (context, *before)
        sums, powers, near = Lattice([word[start - context:start + WINDOW]], pieces)._summed(table, True, before)
        before = (near, powers[-1])
    return np.log(sums[-1][0]) + np.broadcast_to(powers[-1], sums[-1].shape)[0] * np.log(2.0)


def by_length(words: list[str]) -> Iterator[list[str]]:
    """Groups of words of the same length, of bounded size."""
    groups: dict[int, list[str]] = {}
    for word in words:
        groups.setdefault(len(word), []).append(word)
    for length, group in groups.items():
        most = max(1, min(4_096, CELLS // max(1, length)))
        for start in range(0, len(group), most):
            yield group[start:start + most]


def log_probabilities(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Words x languages: the log of the summed probability of each word's segmentations."""
    number = {START + word: i for i, word in enumerate(words)}
    logs = np.zeros((len(words), table.shape[1]))
    for group in by_length(list(number)):
        if len(group[0]) > WINDOW:
            for word in group:
                logs[number[word]] = long_log_sum(word, pieces, table)
        else:
            logs[[number[w] for w in group]] = Lattice(group, pieces).log_sums(table)
    return logs


class Remembered:
    """Rows of numbers by name. Beyond ``limit`` names the half asked for most stays; the others are computed again when
    they come back, which changes no row."""

    def __init__(self, limit: int, width: int):
        self.limit = limit
        self.place: dict[str, int] = {}  # in the order of the places
        self.rows, self.asked = np.zeros((limit, width)), np.zeros(limit, np.int64)

    def rows_of(self, names: list[str], compute: Callable[[list[str]], np.ndarray]) -> np.ndarray:
        """A row for each of ``names``; ``compute`` gives those of names that are not remembered."""
        most = self.limit // 2
        if len(names) > most:
            return np.concatenate([self.rows_of(names[i:i + most], compute) for i in range(0, len(names), most)])
        new = list(set(names).difference(self.place))
        if len(self.place) + len(new) > self.limit:
            self._forget()
            new = list(set(names).difference(self.place))
        if new:
            start = len(self.place)
            self.rows[start:start + len(new)] = compute(new)
            self.asked[start:start + len(new)] = 0
            self.place.update(zip(new, range(start, start + len(new))))
        at = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))
        self.asked += np.bincount(at, minlength=self.limit)
        return self.rows[at]

    def _forget(self) -> None:
        names = list(self.place)
        keep = np.sort(np.argsort(-self.asked[:len(names)], kind="stable")[:self.limit // 2])
        self.rows[:len(keep)] = self.rows[keep]
        self.asked[:len(keep)] = self.asked[keep] // 2
        self.place = {names[at]: i for i, at in enumerate(keep.tolist())}


def summed(owner: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The rows of every owner added up."""
    return np.stack([np.bincount(owner, rows[:, i], size) for i in range(rows.shape[1])], axis=1)


def training_words(docs: DataFrame, key: str, text: str, lang: str, training: Column, per_language: int) -> DataFrame:
    """(lang, word, n) over the chosen training documents."""
    rows = docs.where(training & F.col(lang).isNotNull() & F.col(text).isNotNull())
    share = F.lit(float(per_language)) / F.col("_docs")
    sizes = rows.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("_docs"))
    drawn = F.pmod(F.xxhash64(F.lit("language"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), drawn.alias("_draw")).join(
        F.broadcast(sizes), "_lang").where(F.col("_draw") < share)  # one small row per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, str], int] = {}
            for language, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for token in body.split():
                    for word in words_of(token):
                        counts[language, word] = counts.get((language, word), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
                 pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    words = chosen.select("_lang", "_text").mapInArrow(run, "lang string, word string, n long")
    return words.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
        per_language: int = PER_LANGUAGE, rounds: int = ROUNDS, vocabulary: str | None = None):
    """(languages, table): piece probabilities per language, pieces x languages; row 0 is zero."""
    spark = prepare(docs.sparkSession)
    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    size = len(piece_ids(path).names)
    words = training_words(docs, key, text, lang, training, per_language).persist()
    try:
        languages = sorted(r.lang for r in words.select("lang").distinct().collect())
        table = np.full((size + 1, len(languages)), 1.0 / max(size, 1))
        table[0] = 0.0
        for _ in range(rounds if languages else 0):
            shared = spark.sparkContext.broadcast(table)  # vocabulary x languages: bounded by both

            def expected(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                now, ids = shared.value, piece_ids(path)
                sums = np.zeros_like(now)
                place = {language: i for i, language in enumerate(languages)}
                counts: dict[str, dict[str, int]] = {}

                def add() -> None:
                    for group in by_length(list(counts)):
                        weight = np.zeros((len(group), len(languages)))
                        for i, word in enumerate(group):
                            for language, n in counts[word].items():
                                weight[i, place[language]] += n
                        found, shares = Lattice(group, ids).expected(now, weight)
                        for i in range(len(languages)):
                            sums[:, i] += np.bincount(found, shares[:, i], len(now))
                    counts.clear()

                for batch in batches:
                    for language, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                        of = counts.setdefault(START + word, {})
                        of[language] = of.get(language, 0) + n
                    if len(counts) > 20_000:
                        add()
                add()
                kinds, langs = np.nonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.astype("int32")), pa.array(langs.astype("int32")),
                                                  pa.array(sums[kinds, langs])], names=["piece", "language", "n"])

            sums = words.mapInArrow(expected, "piece int, language int, n double").groupBy("piece", "language").agg(
                F.sum("n").alias("n")).toPandas()
            counts = np.full((size + 1, len(languages)), 0.05)  # pieces not seen keep a little
            counts[sums["piece"], sums["language"]] += sums["n"]
            counts[0] = 0.0
            table = counts / counts.sum(axis=0)
            shared.unpersist()
    finally:
        words.unpersist()
    return languages, table


def predict(docs: DataFrame, model, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    spark = prepare(docs.sparkSession)
    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    languages, table = model
    shared = spark.sparkContext.broadcast(table)
    docs = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ids = shared.value, piece_ids(path)
        tokens_known, words_known = Remembered(TOKENS, len(languages) + 1), Remembered(WORDS, len(languages))

        def learn(new: list[str]) -> np.ndarray:
            """The tokens' log probabilities, and behind them their letters."""
            of = [words_of(token) for token in new]
            words = [w for some in of for w in some]
            logs = words_known.rows_of(words, lambda unknown: log_probabilities(unknown, ids, table))
            letters = np.fromiter(map(len, words), np.float64, len(words))
            owner = np.repeat(np.arange(len(of)), np.fromiter(map(len, of), np.int64, len(of)))
            return summed(owner, np.column_stack([logs, letters]), len(new))

        def add(some: list[tuple[int, list[str]]], total: np.ndarray, count: np.ndarray) -> None:
            """Add the tokens' log probabilities and letters to their texts'."""
            tokens = [t for _, part in some for t in part]
            owner = np.repeat([i for i, _ in some], [len(part) for _, part in some])
            sums = summed(owner, tokens_known.rows_of(tokens, learn), len(total))
            total += sums[:, :-1]
            count += sums[:, -1].astype(np.int64)

        for batch in batches:
            total, count = np.zeros((batch.num_rows, len(languages))), np.zeros(batch.num_rows, np.int64)
            waiting, held = [], 0
            for i, body in enumerate(batch.column(text).to_pylist()):
                tokens = body.split() if body and languages else []
                for start in range(0, len(tokens), AT_ONCE):
                    waiting.append((i, tokens[start:start + AT_ONCE]))
                    held += len(waiting[-1][1])
                    if held >= AT_ONCE:
                        add(waiting, total, count)
                        waiting, held = [], 0
            if waiting:
                add(waiting, total, count)
            found, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            for i in np.flatnonzero(count):
                best = int(np.argmax(total[i]))
                found[i] = languages[best]
                scores[i] = float(1.0 / np.exp((total[i] - total[i][best]) / np.sqrt(count[i])).sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()),
                                              T.StructField("score", T.DoubleType())]))


def held_out(key: str = "doc_id") -> Column:
    """Rows that the fit never sees: a quarter by the checksum of the key."""
    return fold(key, 4) == 2
