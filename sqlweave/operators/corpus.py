"""Corpus jobs: examples, (question, schema, SQL) pairs, splits, coverage, model frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlweave.functions.text import pretokens
from sqlweave.operators.graph import connected_components
from sqlweave.operators.numbering import row_numbers
from sqlweave.operators.specs import validate_specs
from sqlweave.plans.render import with_paraphrases, with_question, with_sql
from sqlweave.session import write_table


def serialize_parts(cat_columns: DataFrame, cat_fks: DataFrame) -> DataFrame:
    """(schema_id, table_name, table_pos, part): ``table : col(pk,fk->t.c,=label), ...`` per table."""
    fk = cat_fks.groupBy("schema_id", F.col("from_table").alias("table_name"),
                         F.col("from_column").alias("column_name")).agg(
        F.min_by(F.concat(F.lit("fk->"), F.col("to_table"), F.lit("."), F.col("to_column")),
                 "fk_pos").alias("fk"))
    c = cat_columns.join(fk, ["schema_id", "table_name", "column_name"], "left")
    tags = F.filter(F.array(F.when(F.col("is_pk"), F.lit("pk")), F.col("fk"),
                            F.when(F.col("business_label").isNotNull(),
                                   F.concat(F.lit("="), F.col("business_label")))),
                    lambda x: x.isNotNull())
    col_text = F.concat(F.col("column_name"), F.when(F.size(tags) > 0, F.concat(
        F.lit("("), F.array_join(tags, ","), F.lit(")"))).otherwise(F.lit("")))
    per_table = c.groupBy("schema_id", "table_name", "table_pos").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_pos", col_text.alias("col_text")))),
                                 lambda x: x["col_text"]), ", ").alias("cols"))
    return per_table.select("schema_id", "table_name", "table_pos",
                            F.concat("table_name", F.lit(" : "), "cols").alias("part"))


def serialize_catalog(cat_columns: DataFrame, cat_fks: DataFrame,
                      tables: DataFrame | None = None, key: str = "schema_id") -> DataFrame:
    """``table : col(pk,fk->t.c,=label), ... | ...`` per ``key``, in catalog order.

    ``tables`` (optional): (key, schema_id, table_name) rows limiting the text to a subset,
    e.g. the tables linked to one question; ``key`` then names its id column. Every
    table's part is written once, however many subsets hold it.
    """
    parts = serialize_parts(cat_columns, cat_fks)
    if tables is not None:
        parts = parts.join(tables.select(*dict.fromkeys([key, "schema_id", "table_name"])).distinct(),
                           ["schema_id", "table_name"])
    elif key != "schema_id":
        parts = parts.withColumn(key, F.col("schema_id"))
    return parts.groupBy(key).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("table_pos", "part"))), lambda x: x["part"]), " | ")
        .alias("schema_text"))


def column_costs(cat_columns: DataFrame, cat_fks: DataFrame) -> DataFrame:
    """(schema_id, table_name, tokens): pre-tokens of each table's part of the catalog text, blanks left out.

    The parts are ``table : col(tags), ...`` and one separator; a subset of tables costs the sum of its parts.
    """
    words = serialize_parts(cat_columns, cat_fks)
    n = F.size(F.filter(pretokens("part"), lambda x: F.trim(x) != ""))
    return words.select("schema_id", "table_name", (n + 1).cast("long").alias("tokens"))


def link_costs(linked: DataFrame, cat_columns: DataFrame, cat_fks: DataFrame) -> DataFrame:
    """(qid, tokens_before, tokens_after) of linked questions on one catalog.

    Every table's cost is counted once for the catalog; a question sums those of its tables, so no
    question encodes a catalog text. An unlinked question carries all tables.
    """
    costs = write_table(column_costs(cat_columns, cat_fks), "costs")
    whole = costs.agg(F.sum("tokens").alias("tokens_before"))  # one row
    chosen = (linked.filter("not link_all").select("qid", F.explode("tables").alias("table_name"))
              .join(costs, "table_name").groupBy("qid").agg(F.sum("tokens").alias("tokens_after")))
    return (linked.select("qid").join(chosen, "qid", "left").crossJoin(F.broadcast(whole))
            .withColumn("tokens_after", F.coalesce("tokens_after", "tokens_before")))


def build_examples(specs: DataFrame, cat_tables: DataFrame, cat_columns: DataFrame,
                   cat_fks: DataFrame, k_paraphrases: int = 3) -> DataFrame:
    """Specs with sql, question, paraphrases and a ``valid`` flag."""
    ex = with_paraphrases(with_question(with_sql(specs)), k_paraphrases)
    bad = validate_specs(specs, cat_tables, cat_columns, cat_fks).select(
        "schema_id", "spec_id").distinct().withColumn("_bad", F.lit(True))
    return (ex.join(bad, ["schema_id", "spec_id"], "left")
            .withColumn("valid", F.col("_bad").isNull()).drop("_bad"))


def training_pairs(examples: DataFrame, schema_text: DataFrame,
                   canonical_only: bool = False) -> DataFrame:
    """One row per distinct question of each example: (question, schema_text, sql)."""
    qs = (F.array("question") if canonical_only
          else F.array_distinct(F.concat(F.array("question"), "paraphrases")))
    return (examples.select("schema_id", "spec_id", "level", "sql", F.posexplode(qs)
                            .alias("q_pos", "question"))
            .join(schema_text, "schema_id"))


def normalised(text) -> Column:
    """A text's identity for leakage: lower case, blanks squeezed, hashed."""
    squeezed = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.sha2(squeezed, 256)


def leakage_groups(rows: DataFrame) -> DataFrame:
    """(item, group) for all items of ``rows`` (item STRING, key STRING): the smallest item reachable over shared keys.

    Items that share a key, directly or through others, are one group, so a split of the groups
    leaves no key on two sides. Keys of one item link nothing and are dropped first.
    """
    keyed = write_table(rows.filter("key is not null").distinct(), "keyed")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("first")).filter("n > 1")
    # every item is tied to its key's smallest item, so a key of many items is a star
    edges = keyed.join(shared, "key").select(F.col("item").alias("a"), F.col("first").alias("b"))
    found = connected_components(edges)
    items = rows.select("item").distinct()
    return items.join(found, items.item == found.node, "left").select(
        "item", F.coalesce("component", "item").alias("group"))


def schema_groups(names: DataFrame, generic: float = 0.25) -> DataFrame:
    """(schema_id, component): catalogs that share a name, directly or through others.

    ``names``: (schema_id, name). A name that more than ``generic`` of all catalogs have is
    structural (an id of the organisation, a segment) and links none.
    """
    names = write_table(names.distinct(), "names")
    n = names.select("schema_id").distinct().count()
    specific = names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= generic * n).select("name")
    linked = names.join(specific, "name", "left_semi").select(F.col("schema_id").alias("item"), F.col("name").alias("key"))
    alone = names.select(F.col("schema_id").alias("item"), F.lit(None).cast("string").alias("key")).distinct()
    return leakage_groups(linked.unionByName(alone)).select(
        F.col("item").alias("schema_id"), F.col("group").alias("component"))


def balanced_split(groups: DataFrame, val_fraction: float = 0.25) -> DataFrame:
    """(schema_id, component, split): whole components in order of name go to val as long as they fit its share."""
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    before = row_numbers(sizes, ["component"], sums={"before": "size"})
    total = groups.count()
    side = F.when(F.col("before") + F.col("size") <= F.lit(val_fraction * total), "val").otherwise("train")
    return groups.join(before.select("component", side.alias("split")), "component").select(
        "schema_id", "component", "split")


def _sides(train: DataFrame, val: DataFrame):
    return train.withColumn("split", F.lit("train")), val.withColumn("split", F.lit("val"))


def split_by_schema(examples: DataFrame, schema_text: DataFrame, val_fraction: float = 0.25,
                    split: DataFrame | None = None):
    """Train / val on disjoint catalogs; val keeps only the plain question.

    ``split`` (schema_id, split), e.g. from ``balanced_split``, says which side a catalog is on;
    without it catalogs are split by a hash of their id.
    """
    if split is None:
        is_val = F.pmod(F.xxhash64("schema_id"), F.lit(1000)) < int(val_fraction * 1000)
        train, val = examples.filter(~is_val), examples.filter(is_val)
    else:
        on = lambda side: examples.join(split.filter(F.col("split") == side), "schema_id", "left_semi")
        train, val = on("train"), on("val")
    return _sides(training_pairs(train, schema_text), training_pairs(val, schema_text, canonical_only=True))


def query_groups(examples: DataFrame) -> DataFrame:
    """(schema_id, spec_id, group): examples that share a SQL text or a question text are one group."""
    item = F.concat_ws(":", "schema_id", "spec_id")
    texts = F.concat(F.array(F.concat(F.lit("q:"), normalised(F.col("sql")))), F.transform(
        F.concat(F.array("question"), "paraphrases"), lambda x: F.concat(F.lit("t:"), normalised(x))))
    groups = leakage_groups(examples.select(item.alias("item"), F.explode(texts).alias("key")))
    keys = examples.select("schema_id", "spec_id", item.alias("item"))
    return keys.join(groups, "item").select("schema_id", "spec_id", "group")


def split_by_query(examples: DataFrame, schema_text: DataFrame, val_fraction: float = 0.25):
    """Same catalogs, disjoint queries: no SQL text and no question text stands on both sides."""
    is_val = F.pmod(F.xxhash64("group"), F.lit(1000)) < int(val_fraction * 1000)
    grouped = examples.join(query_groups(examples), ["schema_id", "spec_id"])
    return _sides(training_pairs(grouped.filter(~is_val), schema_text),
                  training_pairs(grouped.filter(is_val), schema_text, canonical_only=True))


def feature_coverage(examples: DataFrame) -> DataFrame:
    return examples.select(F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count("*").alias("n_examples"))


def throughput_report(examples: DataFrame, seconds: float) -> DataFrame:
    return examples.agg(F.count("*").alias("n_examples"),
                        F.avg(F.col("valid").cast("double")).alias("valid_share")).withColumn(
        "examples_per_sec", F.col("n_examples") / F.lit(max(seconds, 1e-9)))


def corpus_texts(pairs: DataFrame) -> DataFrame:
    """Flatten pairs to one text column (tokenizer input)."""
    return pairs.select(F.explode(F.array("question", "schema_text", "sql")).alias("text"))


def frame_pairs(pairs: DataFrame, merges: DataFrame) -> DataFrame:
    """src = <question> q <schema> s; tgt_in = <bos> sql; labels = sql <eos>.

    Every distinct text is encoded once, so a catalog's text costs one encoding for all its pairs.
    """
    from sqlweave.operators.bpe import DEFAULT_SPECIALS, bpe_encode
    n_merges = merges.count()
    sp = {s: 256 + n_merges + i for i, s in enumerate(DEFAULT_SPECIALS)}
    texts = corpus_texts(pairs).distinct()
    ids = write_table(bpe_encode(texts, merges, "text", "ids"), "encoded")
    e = pairs
    for col, out in (("question", "_q"), ("schema_text", "_s"), ("sql", "_t")):
        e = e.join(ids.select(F.col("text").alias(col), F.col("ids").alias(out)), col)

    def one(name):
        return F.array(F.lit(sp[name]))
    return e.select(
        "schema_id", "spec_id", "q_pos",
        F.concat(one("<question>"), "_q", one("<schema>"), "_s").alias("src"),
        F.concat(one("<bos>"), "_t").alias("tgt_in"),
        F.concat("_t", one("<eos>")).alias("labels"),
        F.lit(sp["<pad>"]).alias("pad_id"))


def pad_batches(framed: DataFrame, batch_size: int = 32) -> DataFrame:
    """Right-pad to the batch maximum and add keep masks.

    Batches are hash buckets of about ``batch_size`` rows, so the per-batch
    maximum is a window over one bucket, never over the whole table.
    """
    n = framed.count()
    n_batches = max(1, -(-n // batch_size))
    b = framed.withColumn("batch_id", F.pmod(F.xxhash64("schema_id", "spec_id", "q_pos"),
                                             F.lit(n_batches)))
    w = Window.partitionBy("batch_id")
    b = (b.withColumn("_sl", F.max(F.size("src")).over(w))
         .withColumn("_tl", F.max(F.size("tgt_in")).over(w)))

    def pad(col, length):
        return F.concat(col, F.array_repeat(F.col("pad_id"), length - F.size(col)))
    b = (b.withColumn("src", pad(F.col("src"), F.col("_sl")))
         .withColumn("tgt_in", pad(F.col("tgt_in"), F.col("_tl")))
         .withColumn("labels", pad(F.col("labels"), F.col("_tl"))))
    return b.withColumn("src_keep", F.transform("src", lambda x: x != F.col("pad_id"))) \
        .withColumn("tgt_keep", F.transform("tgt_in", lambda x: x != F.col("pad_id"))) \
        .drop("_sl", "_tl")
