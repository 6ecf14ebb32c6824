"""Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton gives all vocabulary matches of a word; dynamic programming carries the best score,
the number of pieces and whether the last piece is unknown. Tie rules are those of the tokenizers library's
unigram model: places from left to right, a later path must be better by score, a character that is no piece itself may
stand as an unknown piece at the lowest score less 10, and unknown pieces in a row count as one.

Words are split as by its Metaspace step (blank to U+2581, one put before the text), so that a text's count is the
sum over its words, each distinct word computed once per worker generation of the cache.

Edge cases: a null or empty text has no tokens. A text of any length is counted whole, also one without a blank: memory hangs on the
longest piece. An empty table gives no rows. Repeated rows count each. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import text_column

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Characters that are split at once.
SPLIT_CHARS = 1_000_000
#: Words of a generation of the cache; the generation before is kept too.
CACHE_WORDS = 300_000


class Kept:
    """A cache of two generations."""

    def __init__(self) -> None:
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def missing(self, keys: set[str]) -> set[str]:
        """The keys that neither generation has; afterwards `new` has all others."""
        if len(self.new) > CACHE_WORDS:
            self.old, self.new = self.new, {}
        keys -= self.new.keys()
        again = keys & self.old.keys()
        self.new.update((k, self.old.pop(k)) for k in again)
        return keys - again


class Counter:
    """counts(texts): (tokens, unknown tokens, score) of each text."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.words = Kept()
        #: Places that are held, half of which are more than the longest piece has.
        self.reach = 2 * max((len(piece) for piece, _ in vocabulary), default=0) + 2000

    def word(self, word: str) -> tuple[int, int, float]:
        """One place after the other; no more of them are held than the longest piece reaches back, however long the word is."""
        scores, pieces, unknowns, opens, gone = [0.0], [0], [0], [False], 0
        matches = self.automaton.iter(word)  # by end, of one end the longest first
        match = next(matches, None)
        for end in range(len(word)):
            best, single = None, False
            while match is not None and match[0] == end:
                length, own = match[1]
                k = end + 1 - length - gone
                if best is None or scores[k] + own > best:
                    best, n, unknown, open_ = scores[k] + own, pieces[k] + 1, unknowns[k], False
                single |= length == 1
                match = next(matches, None)
            if not single and (best is None or scores[-1] + self.unknown > best):
                best, n, unknown, open_ = scores[-1] + self.unknown, pieces[-1] + (not opens[-1]), unknowns[-1] + (not opens[-1]), True
            scores.append(best)
            pieces.append(n)
            unknowns.append(unknown)
            opens.append(open_)
            if len(scores) > self.reach:
                cut = len(scores) // 2
                gone += cut
                for x in (scores, pieces, unknowns, opens):
                    del x[:cut]
        return pieces[-1], unknowns[-1], scores[-1]

    @staticmethod
    def split(text: str) -> list[str]:
        if not text:
            return []
        marked = text.replace(" ", MARK)
        return (marked if marked[0] == MARK else MARK + marked).split(MARK)[1:]

    def counts(self, texts: list[str]) -> list[tuple[int, int, float]]:
        split = [self.split(t) for t in texts]
        for w in self.words.missing({w for words in split for w in words}):
            self.words.new[w] = self.word(MARK + w)
        get, out = self.words.new.__getitem__, []
        for words in split:
            tokens = unknown = 0
            score = 0.0
            for a, b, c in map(get, words):
                tokens += a
                unknown += b
                score += c
            out.append((tokens, unknown, score))
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per worker process and file. Pieces and scores of a sentencepiece model file, control pieces left out."""
    if path not in _counters:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _counters[path] = Counter([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))])
    return _counters[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_unknown, score of every whole text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = counter(path)
        for batch in batches:
            found: list[tuple[int, int, float]] = []
            group: list[str] = []
            chars = 0
            for text in text_column(batch).to_pylist():
                group.append(text)
                chars += len(text)
                if chars >= SPLIT_CHARS:
                    found += worker.counts(group)
                    group, chars = [], 0
            found += worker.counts(group)
            yield pa.record_batch({"doc_id": batch.column(0)} | {k: pa.array([x[i] for x in found], t) for i, (k, t) in enumerate((("n_tokens", pa.int64()), ("n_unknown", pa.int64()), ("score", pa.float64())))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_unknown long, score double")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
