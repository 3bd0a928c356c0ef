"""SentencePiece encoding and decoding through a table of distinct marked words.

A piece of a BPE model whose vocabulary has no piece with a white space marker after another
character can never cross from one marked word (a run of markers and what follows it) to the
next, so the merges of a text are the merges of its marked words. Each block of documents is
split into marked words, each distinct one missing from the task's table is segmented once, and
the ids are joined back by position. The table is private to a task and bounded
(`TABLE_WORDS`), so nothing is shuffled; models without that property encode whole texts.

Null text counts as empty; an empty text has no ids and decodes to "". Extra columns are ignored,
repeated rows stay repeated.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

MARK = "▁"
MARKED = re.compile(f"{MARK}+[^{MARK}]*")
#: Most distinct marked words a task keeps; beyond it the table starts anew.
TABLE_WORDS = 250_000
#: Longer marked words are segmented where they stand instead of being kept.
KEPT_CHARS = 64


def pieces_stay_in_words(sp) -> bool:
    """Whether marked words can be segmented one by one: no normalisation, a dummy prefix, BPE,
    no user-defined symbols, and no piece with a marker after another character."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(sp.serialized_model_proto())
    norm, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
    return (
        model.trainer_spec.model_type == pb.TrainerSpec.BPE
        and norm.add_dummy_prefix
        and norm.escape_whitespaces
        and not norm.remove_extra_whitespaces
        and not norm.precompiled_charsmap
        and not model.trainer_spec.treat_whitespace_as_suffix
        and any(p.piece == MARK for p in model.pieces)
        and not any(p.type == kinds.USER_DEFINED or re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces)
    )


class WordTable:
    """Encodes texts by segmenting each distinct marked word once."""

    def __init__(self, model_path: str, most: int = TABLE_WORDS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.whole = not pieces_stay_in_words(self.sp)
        self.ids: dict[str, array] = {}
        self.most = most

    def _segment(self, words: list[str]) -> Iterable[tuple[str, array]]:
        # the model's dummy prefix stands for the first marker of each word; empty input gets none
        for word, ids in zip(words, self.sp.encode([w[1:] for w in words], num_threads=1), strict=True):
            yield word, array("i", ids if word != MARK else [self.sp.piece_to_id(MARK)])

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        if self.whole:
            yield from self.sp.encode([t or "" for t in texts], num_threads=1)
            return
        split = [MARKED.findall(f"{MARK}{t}".replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*split) - self.ids.keys()
        if len(self.ids) + len(new) > self.most:
            self.ids.clear()
            new = set().union(*split)
        table = self.ids
        table.update(self._segment([w for w in new if len(w) <= KEPT_CHARS]))
        long = dict(self._segment([w for w in new if len(w) > KEPT_CHARS]))
        for words in split:
            yield list(chain.from_iterable(map(table.__getitem__, words))) if not long else list(chain.from_iterable(long[w] if w in long else table[w] for w in words))


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) for every row of `docs`."""

    def make():
        words = WordTable(model_path)

        def rows(keys, texts):
            for key, ids in zip(keys, words.encode(texts), strict=True):
                yield key, ids, words.sp.decode(ids) if ids else ""

        return rows

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col), F.col(text_col)), make, f"`{id_col}` {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of `encode_decode`'s rows."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
