"""How far the sources of a language diverge in their words.

Terms are counted in Arrow batches and added up by Spark. Shares are whole
billionths with one added to every count, so all results are integers.

A pair of sources is priced from its joint table: how many terms have count a
in one and b in the other. With one 0/1 column for every (source, count level)
and one row for every term, all joint tables of a language are the product of
that indicator matrix's transpose with itself. The matrix is cut into blocks of
terms and blocks of sources; a task multiplies two blocks over their nonzeros,
and Spark adds the blocks' products. Level 0, by far the fullest, has no column:
what it holds is the table's margin less its other entries.

Defined cases: null text, lang and source count as ''. A (lang, source) without
terms takes part with counts of 0; a language without kept terms prices its
pairs at 0 and has no term rows; an empty table gives no rows. Repeated rows are
documents of their own. Only ``text``, ``lang`` and ``source`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import once
from ..session import stored
from .common import pieces, split_words

ONE = 1_000_000_000  # shares are whole parts of this
_SOURCES = 48  # sources in a block, on average
_PLAIN = 9_000_000_000  # counts below give products with ONE that fit a long
_ENTRIES = 1 << 18  # nonzeros of a block of terms, on average
_COUNTS = "lang string, source string, term string, n long, docs long"
_JOINT = "lang string, g string, a long, h string, b long, terms long"


def _letters() -> bytes:
    """Byte map: A-Z to lower case, other ASCII but letters to a space; bytes of longer code points stay."""
    return bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _folded(texts: pa.Array, letters: bytes) -> pa.Array:
    texts = pa.concat_arrays([pc.fill_null(texts, "")])
    _, offsets, data = texts.buffers()
    folded = (data.to_pybytes() if data else b"").translate(letters)
    return pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(folded), offset=texts.offset)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) of a piece of a batch; a null term marks that a group occurs."""
    letters = _letters()
    for batch in batches:
        langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        whole = pa.record_batch({"text": _folded(batch.column("text"), letters), "row": pa.array(np.arange(batch.num_rows))})
        lang_of, source_of = langs.indices.to_numpy().astype(np.int64), sources.indices.to_numpy().astype(np.int64)
        group_of = lang_of * max(1, len(sources.dictionary)) + source_of
        groups, group_of = np.unique(group_of, return_inverse=True)
        per = max(1, len(sources.dictionary))

        def named(group: np.ndarray) -> dict:
            return {"lang": langs.dictionary.take(pa.array(groups[group] // per)),
                    "source": sources.dictionary.take(pa.array(groups[group] % per))}

        every = np.arange(len(groups))
        none = pa.array(np.zeros(len(groups), np.int64))
        yield pa.record_batch({**named(every), "term": pa.nulls(len(groups), pa.string()), "n": none, "docs": none})
        for piece in pieces(whole, "text"):
            words, starts = split_words(piece.column("text"))
            n_terms = len(words.dictionary)
            if not n_terms:
                continue
            row = np.repeat(piece.column("row").to_numpy(), np.diff(starts))
            in_doc, n = np.unique(row * n_terms + words.indices.to_numpy(), return_counts=True)
            key = group_of[in_doc // n_terms] * n_terms + in_doc % n_terms
            order = np.argsort(key, kind="stable")
            key, first = np.unique(key[order], return_index=True)
            yield pa.record_batch({
                **named(key // n_terms), "term": words.dictionary.take(pa.array(key % n_terms)),
                "n": pa.array(np.add.reduceat(n[order], first)), "docs": pa.array(np.diff(np.append(first, len(order))))})


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all documents; every occurring (lang, source) also has one row with a null term."""
    read = docs.select("text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    return (read.mapInArrow(_count_terms, _COUNTS).groupBy("lang", "source", "term")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _share(n: Column, words: Column, terms: Column) -> Column:
    """1 + floor(ONE * (n + 1) / (words + terms)); decimals take over where the product leaves a long."""
    wide = F.call_function("div", F.lit(ONE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (words + terms).cast("decimal(20,0)"))
    return F.when(n < _PLAIN, F.call_function("div", ONE * (n + 1), words + terms)).otherwise(wide.cast("long")) + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _product(key: tuple, block: pa.Table) -> pa.Table:
    """Joint counts of the (source, level) columns of two blocks: transpose of the indicator block times itself, by its nonzeros.

    A row of the block is a nonzero: term, column, and which of the two blocks
    it is from (one and the same on the diagonal). Nonzeros k places apart in
    term order meet for k = 1, 2, ...; no term has more than one per source.
    """
    lang, _, left, right = (part.as_py() for part in key)
    terms = block.column("term").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    sources = block.column("source").combine_chunks().dictionary_encode()
    levels, level_of = np.unique(block.column("n").to_numpy(), return_inverse=True)
    columns, column = np.unique(sources.indices.to_numpy().astype(np.int64) * len(levels) + level_of, return_inverse=True)
    side = block.column("side").to_numpy()
    order = np.lexsort((column, side, terms))
    terms, column, side = terms[order], column[order], side[order]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k in range(1, len(terms)):
        meet = terms[k:] == terms[:-k]
        if not meet.any():
            break
        if left != right:
            meet &= side[k:] != side[:-k]
        pair, n = np.unique(column[:-k][meet] * len(columns) + column[k:][meet], return_counts=True)
        found.append((pair, n))
    pair, back = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
    n = np.bincount(back, np.concatenate([c for _, c in found])).astype(np.int64)
    one, two = columns[pair // len(columns)], columns[pair % len(columns)]

    def name(c: np.ndarray) -> pa.Array:
        return sources.dictionary.take(pa.array(c // len(levels)))

    return pa.table({"lang": pa.repeat(pa.scalar(lang, pa.string()), len(n)), "g": name(one), "a": pa.array(levels[one % len(levels)]),
                     "h": name(two), "b": pa.array(levels[two % len(levels)]), "terms": pa.array(n)})


def joint_tables(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, g, a, h, b, terms): how many terms occur a > 0 times in source g and b > 0 times in source h; each pair in one order.

    ``kept`` has lang, source, term, n; ``sizes`` lang, sources and entries (rows of ``kept``) of each language.
    """
    blocks = F.ceil(F.col("sources") / _SOURCES)
    mine = F.pmod(F.xxhash64("source"), blocks)
    dealt = kept.join(sizes, "lang").select(
        "lang", "source", "term", "n", mine.alias("mine"),
        F.pmod(F.xxhash64("term"), F.ceil(F.col("entries") / _ENTRIES)).alias("t"),
        F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    cells = dealt.select("lang", "t", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "source", "term", "n",
                         (F.col("mine") > F.col("other")).cast("int").alias("side"))
    # A source's column may come first in one block of terms and second in another.
    ordered = F.col("g") < F.col("h")
    part = cells.groupBy("lang", "t", "i", "j").applyInArrow(_product, _JOINT)
    return (part.select("lang", *[F.when(ordered, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in zip("gahb", "hbga")], "terms")
            .groupBy("lang", "g", "a", "h", "b").agg(F.sum("terms").alias("terms")))


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language, and the source's overweight terms.

    A language keeps the terms of at least ``least_docs`` documents. With p the
    source's and q the item's share of a term, f = floor((p - q)^2 / q): a
    pair's value is the sum over kept terms, a term's is f against the whole
    language, for terms with p > q; of those the first ``top`` are reported.
    """
    counts = stored(term_counts(docs), "divergence-counts")
    groups = counts.where(F.col("term").isNull()).select("lang", "source")
    words = counts.where(F.col("term").isNotNull())
    by_lang = words.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = stored(words.drop("docs").join(by_lang.drop("docs"), ["lang", "term"]), "divergence-kept")

    in_lang = (kept.groupBy("lang", "term").agg(F.first("total").alias("total"), F.count("*").alias("entries"))
               .groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all_words"), F.sum("entries").alias("entries")))
    in_lang = (groups.groupBy("lang").agg(F.count("*").alias("sources")).join(in_lang, "lang", "left").na.fill(0))
    in_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    size = stored(groups.join(in_group, ["lang", "source"], "left").na.fill(0, ["words"]).join(in_lang, "lang"), "divergence-sizes")

    priced = kept.join(size, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("words"), F.col("v")).alias("p"),
        _share(F.col("total"), F.col("all_words"), F.col("v")).alias("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (priced.where("p > q")
             .select("lang", "source", F.lit("term").alias("part"), "item", _gap(F.col("p"), F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))

    # Every ordered pair starts as if no term occurred in either source; rows below add what levels over 0 change.
    zero, v = F.lit(0).cast("long"), F.col("v")
    one = size.select("lang", F.col("source").alias("g"), F.col("words").alias("g_words"), "v",
                      F.when(v > 0, _share(zero, F.col("words"), v)).alias("g_0"))
    two = one.select("lang", F.col("g").alias("h"), F.col("g_words").alias("h_words"), F.col("g_0").alias("h_0"))
    pairs = one.join(two, "lang").where("g <> h")
    terms_here = F.col("terms").cast("decimal(20,0)")
    g_0, h_0, g_a, h_b = (F.col(c) for c in ("g_0", "h_0", "g_a", "h_b"))

    def change(source: str, item: str, amount: Column) -> Column:
        return F.struct(F.col(source).alias("source"), F.col(item).alias("item"), (terms_here * amount).alias("value"))

    base = pairs.select("lang", F.col("g").alias("source"), F.col("h").alias("item"),
                        F.when(v > 0, v.cast("decimal(20,0)") * _gap(g_0, h_0)).otherwise(0).cast("decimal(38,0)").alias("value"))
    levels = kept.groupBy("lang", F.col("source").alias("g"), F.col("n").alias("a")).agg(F.count("*").alias("terms"))
    margin = once(levels.join(pairs, ["lang", "g"]), ["lang", "g", "h", "g_0", "h_0", "terms"], g_a=_share(F.col("a"), F.col("g_words"), v))
    margin = margin.select("lang", F.inline(F.array(
        change("g", "h", _gap(g_a, h_0) - _gap(g_0, h_0)), change("h", "g", _gap(h_0, g_a) - _gap(h_0, g_0)))))
    joint = joint_tables(kept, size.select("lang", "sources", "entries").distinct()).join(pairs, ["lang", "g", "h"])
    joint = once(joint, ["lang", "g", "h", "g_0", "h_0", "terms"], g_a=_share(F.col("a"), F.col("g_words"), v),
                 h_b=_share(F.col("b"), F.col("h_words"), v))
    joint = joint.select("lang", F.inline(F.array(
        change("g", "h", _gap(g_a, h_b) - _gap(g_a, h_0) - _gap(g_0, h_b) + _gap(g_0, h_0)),
        change("h", "g", _gap(h_b, g_a) - _gap(h_b, g_0) - _gap(h_0, g_a) + _gap(h_0, g_0)))))
    prices = (base.unionAll(margin).unionAll(joint).groupBy("lang", "source", "item")
              .agg(F.sum("value").cast("long").alias("value"))
              .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
              .withColumn("rank", F.row_number().over(order)))
    return prices.unionAll(terms)


#: The same result in DuckDB's SQL, term by term instead of by joint tables.
SQL = r"""
with docs as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
words as (select row, lang, source, unnest(terms) as term from docs),
groups as (select distinct lang, source from docs),
vocabulary as (select lang, term, count(*) as total from words group by lang, term having count(distinct row) >= 3),
counts as (select w.lang, w.source, w.term, count(*) as n from words w join vocabulary k on k.lang = w.lang and k.term = w.term group by all),
in_lang as (select lang, count(*)::hugeint as v, sum(total)::hugeint as words from vocabulary group by lang),
in_group as (select g.lang, g.source, coalesce(sum(n), 0)::hugeint as words from groups g left join counts c on c.lang = g.lang and c.source = g.source group by all),
shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000 * (coalesce(c.n, 0) + 1)::hugeint // (g.words + l.v) as p,
    1 + 1000000000 * (k.total + 1)::hugeint // (l.words + l.v) as q
  from in_group g join in_lang l on l.lang = g.lang join vocabulary k on k.lang = g.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from shares a join shares b on b.lang = a.lang and b.term = a.term and b.source <> a.source group by all
  union all
  select a.lang, a.source, 'pair', b.source, 0 from groups a join groups b on b.lang = a.lang and b.source <> a.source
  where a.lang not in (select lang from in_lang)),
terms as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value from shares where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 200
"""
