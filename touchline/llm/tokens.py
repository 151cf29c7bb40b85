"""Encoding of a whole corpus with a public byte-level BPE tokenizer through a distinct-word table.

Texts are split into words by the tokenizer's own pattern inside Spark, each distinct word is encoded once, and the ids are joined
back by position. The most frequent words (bounded in number and in bytes) are joined by a vectorised look-up next to the texts; occurrences
of all other words go through a join with the rest of the word table and are put into their places.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import cut, sized_join

#: Folder of the public tokenizers; a parameter of every function that reads it.
TOKENIZERS = os.environ.get("TOUCHLINE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern by which the tokenizer splits texts into words, with white space as in Unicode.
WORD_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The words looked up beside the texts, and the bytes and ids that each of them has at most: about 35 MB together. The word table itself has no bound.
HEAD_WORDS, HEAD_WORD_BYTES, HEAD_WORD_IDS = 200_000, 32, 32


def words_of(text):
    """Column: the words of a text in order; empty for empty and null texts."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def word_table(docs: DataFrame, text: str, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """word, n (texts that have it), ids: every distinct word of the corpus, encoded once. Written to the checkpoint folder."""
    distinct = docs.select(F.explode(F.array_distinct(words_of(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(os.path.join(tokenizers, f"{name}.json"))
        tokenizer.encode_special_tokens = True
        # a word is a unit already: only map its bytes
        tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        for batch in batches:
            codes = tokenizer.encode_batch_fast(batch.column("word").to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array([c.ids for c in codes], pa.list_(pa.int32()))], ["word", "n", "ids"])

    return cut(distinct.mapInArrow(encode, "word string, n long, ids array<int>"))


def _offsets(lengths: pa.Array) -> pa.Array:
    return pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(pc.cast(lengths, pa.int64()))])


def _looked_up(docs: DataFrame, key: str, text: str, table: DataFrame, head_words: int, counts: bool) -> tuple[DataFrame, DataFrame]:
    """The texts with what the commonest words give, and the rest of the word table.

    Of the texts: k, ids (with ``counts`` their number instead), and gaps: per missing word how many ids precede it in the text, its number among the text's words, and the word.
    """
    short = (F.octet_length("word") <= HEAD_WORD_BYTES) & (F.size("ids") <= HEAD_WORD_IDS)
    ordered = table.where(short).orderBy(F.desc("n"), "word").limit(head_words).select("word", "n", "ids").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((pc.cast(ordered["word"].combine_chunks(), pa.large_string()), pc.cast(ordered["ids"].combine_chunks(), pa.large_list(pa.int32()))))
    if len(ordered) < head_words:
        rest = table.where(~short)
    else:  # in the order of the head: rarer than its last word, or as rare and later in the alphabet
        last, word = ordered["n"][-1].as_py(), ordered["word"][-1].as_py()
        rest = table.where(~short | (F.col("n") < last) | ((F.col("n") == last) & (F.col("word") > word)))
    key_type = dict(docs.dtypes)[key]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codes = shared.value
        for batch in batches:
            words = batch.column("words")
            flat = pc.cast(words.flatten(), pa.large_string())
            at = pc.index_in(flat, value_set=known)
            found = codes.take(at)  # one list per word, null where the word is not in the head
            starts = _offsets(pc.fill_null(pc.list_value_length(found), 0))
            word_starts = pc.cast(pc.subtract(words.offsets, words.offsets[0]), pa.int64())
            id_starts = starts.take(word_starts)
            if counts:
                out = pc.cast(pc.subtract(id_starts[1:], id_starts[:-1]), pa.int64())
            else:
                out = pc.cast(pa.LargeListArray.from_arrays(id_starts, pc.cast(found.drop_null().flatten(), pa.int32())), pa.list_(pa.int32()))
            gap_at = pc.indices_nonzero(pc.is_null(at))
            # the texts' gaps: the missing word, its number in the text, and how many ids precede it
            gap_doc = pc.list_parent_indices(words).take(gap_at)
            ordinal = pc.subtract(pc.cast(gap_at, pa.int64()), word_starts.take(gap_doc))
            before = pc.subtract(starts.take(gap_at), id_starts.take(gap_doc))
            per_doc = np.bincount(gap_doc.to_numpy(zero_copy_only=False).astype(np.int64), minlength=len(batch))
            gaps = pa.StructArray.from_arrays([pc.cast(before, pa.int32()), pc.cast(ordinal, pa.int32()), pc.cast(flat.take(gap_at), pa.string())], ["before", "ordinal", "word"])
            gap_lists = pa.ListArray.from_arrays(pc.cast(_offsets(pa.array(per_doc)), pa.int32()), gaps)
            yield pa.RecordBatch.from_arrays([batch.column("k"), out, gap_lists], ["k", "ids", "gaps"])

    schema = f"k {key_type}, ids {'long' if counts else 'array<int>'}, gaps array<struct<before:int,ordinal:int,word:string>>"
    pieces = docs.select(F.col(key).alias("k"), words_of(F.col(text)).alias("words")).mapInArrow(look_up, schema)
    # written once, so that the row numbers stay the same whatever is computed again
    return cut(pieces.withColumn("row", F.monotonically_increasing_id())), rest


def encode(docs: DataFrame, key: str, text: str, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k", head_words: int = HEAD_WORDS) -> DataFrame:
    """key, ids: the token ids of each text, without special tokens (their strings are ordinary text).

    Empty and null texts have an empty list. One row comes out for each row of ``docs``, repeated and null keys included; an
    empty table gives no rows; texts of any length are encoded whole; other columns are not read. The result does not depend on ``head_words``.
    """
    pieces, rest = _looked_up(docs, key, text, word_table(docs, text, tokenizers, name), head_words, False)
    missing = sized_join(pieces.select("row", F.inline("gaps")), rest.select("word", F.col("ids").alias("fill")), ["word"])
    fills = missing.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("ordinal", "before", "fill"))).alias("fills"))
    # between two gaps lie the ids that both looked-up ends leave
    done = lambda i: F.when(i == 0, 0).otherwise(F.get("fills", i - 1)["before"])
    stretches = F.transform("fills", lambda g, i: F.concat(F.slice(F.col("ids"), done(i) + 1, g["before"] - done(i)), g["fill"]))
    merged = F.concat(F.flatten(stretches), F.slice(F.col("ids"), F.element_at("fills", -1)["before"] + 1, F.size("ids")))
    whole = pieces.where("size(gaps) = 0").select(F.col("k").alias(key), "ids")
    return whole.unionByName(pieces.where("size(gaps) > 0").join(fills, "row").select(F.col("k").alias(key), merged.alias("ids")))


def decode(encoded: DataFrame, key: str, ids: str, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """key, text: each list of ids as text again, by a join of ids with the pieces (one row per id of the vocabulary, a fixed size).

    An empty list and null give empty text; an id outside the vocabulary contributes nothing; bytes that are no UTF-8 become U+FFFD.
    """
    key_type = dict(encoded.dtypes)[key]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(os.path.join(tokenizers, f"{name}.tiktoken"), "rb") as file:
            ranks = {int(i): base64.b64decode(piece) for piece, i in map(bytes.split, file)}
        pieces = pa.array([ranks.get(i, b"") for i in range(max(ranks) + 1)], pa.large_binary())
        for batch in batches:
            lists = pc.fill_null(pc.cast(batch.column("ids"), pa.large_list(pa.int32())), [])
            flat = lists.flatten()
            inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces)))
            parts = pieces.take(pc.if_else(inside, flat, None))
            # the pieces lie in one buffer in order, so a text is the stretch of bytes from its first piece to its last
            parts = pc.fill_null(parts, b"")
            ends = _offsets(pc.binary_length(parts)).take(pc.cast(pc.subtract(lists.offsets, lists.offsets[0]), pa.int64())).to_pylist()
            joined = b"".join(parts.to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([joined[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])], pa.string())], ["k", "text"])

    return encoded.select(F.col(key).alias("k"), F.col(ids).alias("ids")).mapInArrow(join, f"k {key_type}, text string").withColumnRenamed("k", key)


def token_counts(docs: DataFrame, key: str, text: str, columns: list[str], tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k", head_words: int = HEAD_WORDS) -> DataFrame:
    """key, columns, tokens: the number of tokens of each text, from the lengths in the word table; no list of ids is made. 0 for empty and null texts; a row for each row of ``docs``."""
    packed = docs.select(F.struct(key, *columns).alias("k"), text)
    pieces, rest = _looked_up(packed, "k", text, word_table(packed, text, tokenizers, name), head_words, True)
    missing = sized_join(pieces.select("row", F.inline("gaps")), rest.select("word", F.size("ids").alias("n")), ["word"])
    more = missing.groupBy("row").agg(F.sum("n").alias("more"))
    whole = pieces.where("size(gaps) = 0").select("k.*", F.col("ids").alias("tokens"))
    return whole.unionByName(pieces.where("size(gaps) > 0").join(more, "row").select("k.*", (F.col("ids") + F.col("more")).alias("tokens")))
