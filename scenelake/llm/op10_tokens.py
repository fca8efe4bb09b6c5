"""Operator 10: token counts by byte-pair merging with a heap and a linked list.

A piece model merges adjacent symbols, best-ranked pair first, until no pair is a piece. The count of a text is
its initial symbols minus the merges; identifiers are never made. Characters that are no piece and are left alone
count as their UTF-8 bytes. Merges never cross the start of a run of spaces, because no piece has a space after
another character (checked when the model is read; else whole texts are merged at once), so that equal words
share one count.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.llm.common import documents, id_and_text, texts_of

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Counts that a worker remembers, at most; then it starts anew.
REMEMBERED = 400_000
SPACE = "▁"


class Counter:
    """Token counts for one piece model; path: a file for the sentencepiece library, of BPE kind with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        #: piece -> rank; the higher score comes first
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.rank)
        self.known: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Tokens of a string of symbols, all at once."""
        rank, symbols = self.rank, list(word)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, pair) for i in range(n - 1) if (r := rank.get(pair := symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j < 0 or symbols[i] + symbols[j] != pair:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = pair, None
            merges += 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get(more := pair + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, more))
            if (h := before[i]) >= 0 and (r := rank.get(more := symbols[h] + pair)) is not None:
                heapq.heappush(heap, (r, h, more))
        unknown = sum(len(s.encode()) - 1 for s in symbols if s is not None and len(s) == 1 and s not in rank)
        return n - merges + unknown

    def word(self, word: str) -> int:
        count = self.known.get(word)
        if count is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            count = self.merged(word)
            if len(word) < 64:
                self.known[word] = count
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)  # a space goes before every text
        if not self.splits:
            return self.merged(text)
        if SPACE * 2 in text:
            return sum(map(self.word, re.findall(f"{SPACE}+[^{SPACE}]*", text)))
        known, words = self.known, text[1:].split(SPACE)
        return sum([known.get(w) or self.word(w) for w in [SPACE + x for x in words]])


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each worker process and path."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of docs.

    A null text counts as empty: no bytes, no tokens. Ids may be null or repeated. An empty table gives an empty
    result. Only doc_id and text are read; path is the model's file on every executor.
    """

    def tokens(batches):
        own = counter(path)
        for b in batches:
            texts = texts_of(b)
            counts = [own.count(x.decode()) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return id_and_text(docs).mapInArrow(tokens, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op10(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    return count_tokens(documents(spark, sf_dir), path)
