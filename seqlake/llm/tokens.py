"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, slices, table

#: Where the public tokenizers lie, and the vocabulary that the registered query counts with.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose new pre-tokens make one walk, and terminals that a task may keep before it starts anew.
CHUNK, TERMINALS = 8 << 20, 400_000
#: What begins a word, and what a character outside the vocabulary costs a byte, in nats below the rarest piece.
WORD, PENALTY = "▁", 2.0


@lru_cache(maxsize=2)
def load(path: str) -> dict[str, float]:
    """Log probability of each ordinary piece of a sentencepiece model.

    None of the public vocabularies is a unigram model, so none has probabilities: this one lists its pieces by rank,
    and Zipf's law over the ranks stands in for them.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (k + 2.7) for k in range(len(pieces))))
    return {p: -math.log(k + 2.7) - total for k, p in enumerate(pieces)}


class Trie:
    """Token counts of pre-tokens, by one walk over the trie of those that are new.

    Sorted pre-tokens are the trie in depth-first order. A node stands for a prefix and has the best score of its
    segmentations and that one's number of tokens; the walk keeps those of the nodes above it, so each is worked out
    once for all pre-tokens that share the prefix, and stores the count at every terminal. A tie goes to fewer tokens.
    A character in no piece is a token for each of its bytes.
    """

    def __init__(self, pieces: dict[str, float]):
        #: The pieces and, without a score, the ends of pieces: past what it lacks, no longer candidate need be tried.
        self.ending: dict[str, float | None] = {p[k:]: None for p in pieces for k in range(1, len(p))} | pieces
        self.unknown = min(pieces.values(), default=0.0) - PENALTY
        self.count: dict[bytes, int] = {}

    def insert(self, words: Iterable[bytes]) -> None:
        """Store the terminal counts of pre-tokens, given as UTF-8."""
        if len(self.count) > TERMINALS:
            self.count.clear()
        get, unknown, count = self.ending.get, self.unknown, self.count
        best, tokens = [0.0], [0]
        before = ""
        for word in sorted(set(words).difference(count)):
            text = WORD + word.decode()
            shared, most = 0, min(len(text), len(before))
            while shared < most and text[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                score = number = None
                for start in range(end - 1, -1, -1):
                    value = get(text[start:end], 0)
                    if value == 0:
                        break
                    if value is not None:
                        value += best[start]
                        if score is None or value > score or value == score and tokens[start] < number:
                            score, number = value, tokens[start]
                if number is not None:
                    number += 1
                if get(text[end - 1]) is None:
                    size = len(text[end - 1].encode())
                    value = best[end - 1] + size * unknown
                    if score is None or value > score:
                        score, number = value, tokens[end - 1] + size
                best.append(score)
                tokens.append(number)
            count[word] = tokens[-1]
            before = text


_tries: WeakKeyDictionary[Broadcast, Trie] = WeakKeyDictionary()


def trie_of(pieces: Broadcast[dict[str, float]]) -> Trie:
    """The Trie that this Python process keeps for a broadcast vocabulary, with the counts of its earlier tasks.

    It goes with the broadcast, which Spark takes from a process whose next task has no use for it: processes outlive
    their stages, and what they kept would stand beside all that comes after.
    """
    if pieces not in _tries:
        _tries[pieces] = Trie(pieces.value)
    return _tries[pieces]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row's whole text.

    Pre-tokens are runs of characters other than ASCII white space, each with a mark of its beginning. A task inserts
    the different pre-tokens of its rows into a trie, which the tasks of one Python process share, so no row is moved;
    TERMINALS and CHUNK bound its memory. A null text has no tokens; repeated rows repeat; ties go to fewer tokens; an
    empty table gives no rows; other columns are ignored.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load(vocabulary))  # a vocabulary's size, which is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(pieces)
        for batch in slices(batches, "text", CHUNK):
            texts, words, tokens = blobs(batch.column("text")), [], []
            trie.insert(chain.from_iterable(map(bytes.split, texts)))
            for text in texts:
                found = text.split()
                words.append(len(found))
                tokens.append(sum(map(trie.count.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")


def op4_unigram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count_tokens() of all documents; nulls, ties, repeats and empty tables as there."""
    return count_tokens(table(spark, sf_dir, "documents"))
