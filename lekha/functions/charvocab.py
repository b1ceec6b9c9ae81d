"""Character vocabularies for the modern side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .expr import chars, col, let

# Special tokens and their ids.
SPECIALS = ("<pad>", "<bos>", "<eos>", "<unk>")
PAD, BOS, EOS, UNK = range(4)


def build_char_vocab(df: DataFrame, text: str) -> DataFrame:
    """(char, id): the specials, then the distinct characters by code point.

    The ranking runs in one task, over at most the characters of Unicode.
    """
    seen = df.select(F.explode(chars(text)).alias("char")).distinct()
    ranked = seen.select("char", (F.row_number().over(W.orderBy("char")) + (len(SPECIALS) - 1)).alias("id"))
    spark = df.sparkSession
    specials = spark.createDataFrame(list(zip(SPECIALS, range(4))), "char string, id int")
    return specials.unionByName(ranked)


def encode_chars(df: DataFrame, key: list[str], text: str, vocab: DataFrame) -> DataFrame:
    """Ids per text; characters outside the vocabulary get the unknown id.

    Looks characters up with a join instead of a per-row map, and keeps the
    work of a long text spread by (row, block of positions).
    """
    exploded = df.select(*key, F.posexplode(chars(text)).alias("pos", "char"))
    ids = exploded.join(vocab, "char", "left").select(
        *key, "pos", F.coalesce("id", F.lit(UNK)).alias("id")
    )
    encoded = ids.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("_s"))
    out = encoded.select(*key, F.col("_s.id").alias("ids"))
    return df.select(*key).join(out, key, "left").select(
        *key, F.coalesce("ids", F.array().cast("array<int>")).alias("ids")
    )


def decode_ids(ids: Column | str, vocab_chars: Column) -> Column:
    """Text up to the end mark, padding and start marks skipped.

    ``vocab_chars`` is the array of characters by id.
    """

    def body(seq: Column) -> Column:
        end = F.array_position(seq, F.lit(EOS)).cast("int")
        kept = F.when(end > 0, F.slice(seq, 1, F.greatest(end - 1, F.lit(0)))).otherwise(seq)
        real = F.filter(kept, lambda i: ~i.isin(PAD, BOS))
        return F.array_join(
            F.transform(real, lambda i: F.coalesce(F.get(vocab_chars, i), F.lit(SPECIALS[UNK]))), ""
        )

    return let(col(ids), body)
