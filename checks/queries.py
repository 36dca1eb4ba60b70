"""Queries over whole test tables. Each takes (spark, folder of parquet tables)."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.config import LinkConfig
from kindred.errors import CleaningError
from kindred.functions.distance import indel_ratio, jaro_winklers
from kindred.functions.text import combined_key, sorted_tokens
from kindred.linkage.candidates import (
    candidate_levels, candidate_pairs, needed_agreement, rule_forecast, with_levels,
)
from kindred.linkage.model import LinkModel, explain_pairs, match_weights
from kindred.linkage.records import merge_copies, record_rows
from kindred.linkage.runs import dedupe_records, link_records, score
from kindred.linkage.train import (
    Patterns, agreeing_per_key, all_pairs_of, blocked_patterns, equal_pairs, estimate_prior,
    random_patterns, train, u_shares,
)
from kindred.operators.audit import audit_members, summary, union_audits
from kindred.operators.clean import clean_table
from kindred.operators.cluster import connected_components
from kindred.operators.exact import dedup_exact
from kindred.operators.fuzzy import batch_scorer, block_pairs, dedup_fuzzy, match_keys
from kindred.operators.normalize import normalize
from kindred.operators.profile import common_columns, preview, profile_columns, profile_summary
from kindred.plans.cut import cut_lineage, shared_folder
from kindred.plans.ids import with_row_id
from kindred.plans.pairs import pair_forecast
from kindred.sources.tables import read_numbered, read_table, write_result, write_table

# Fixed models, so that scoring can be checked apart from training.
DOCUMENT_CONFIG = LinkConfig(
    {"text": "exact", "source": "exact", "lang": "exact", "n_chars": "phone"},
    threshold=0.9, blocking=("text", "n_chars"),
)
DOCUMENT_MODEL = LinkModel(
    0.001, DOCUMENT_CONFIG.comparisons,
    {"text": [0.1, 0.9], "source": [0.7, 0.3], "lang": [0.05, 0.95],
     "n_chars": [0.05, 0.05, 0.1, 0.8]},
    {"text": [0.999, 0.001], "source": [0.95, 0.05], "lang": [0.55, 0.45],
     "n_chars": [0.9, 0.06, 0.03, 0.01]},
)
SUPPLIER_KINDS = {"name": "name", "nation": "exact", "balance": "phone"}
PARTY_CONFIG = LinkConfig(
    {"name": "name", "nation": "exact", "balance": "phone"}, threshold=0.3,
    blocking=("nation", "balance"),
)
PARTY_MODEL = LinkModel(
    0.01, PARTY_CONFIG.comparisons,
    {"name": [0.1, 0.2, 0.2, 0.2, 0.3], "nation": [0.05, 0.95],
     "balance": [0.1, 0.2, 0.3, 0.4]},
    {"name": [0.5, 0.3, 0.1, 0.09, 0.01], "nation": [0.96, 0.04],
     "balance": [0.9, 0.09, 0.009, 0.001]},
)

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- profile, normalise, ids -------------------------------------------------------------------

def profile_summary_events(spark, folder):
    return profile_summary(table(spark, folder, "events"))


def profile_dup_rows_part(spark, folder):
    part = table(spark, folder, "part").drop("p_partkey", "p_retailprice")
    return profile_summary(part)


def profile_columns_labelled_documents(spark, folder):
    labelled = table(spark, folder, "documents").join(
        table(spark, folder, "labels"), "doc_id", "left"
    )
    return profile_columns(labelled)


def normalize_customer_name(spark, folder):
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return normalize(customer, {"c_name": ["trim", "lowercase"], "c_mktsegment": ["lowercase"]})


def normalize_email_like_urls(spark, folder):
    return normalize(table(spark, folder, "pages").select("page_id", "url"), {"url": ["email"]})


def normalize_phone_digits_documents(spark, folder):
    return normalize(table(spark, folder, "documents").select("doc_id", "text"), {"text": ["phone"]})


def normalize_trim_documents(spark, folder):
    out = normalize(table(spark, folder, "documents").select("doc_id", "text"), {"text": ["trim"]})
    return out.withColumn("text", F.md5("text"))


def normalize_nulls_labelled_documents(spark, folder):
    """Labels are missing for many documents: configured columns become text, null the empty one."""
    labelled = table(spark, folder, "documents").select("doc_id").join(
        table(spark, folder, "labels"), "doc_id", "left"
    )
    return normalize(labelled, {"quality": ["trim"], "toxic": ["phone"]})


def row_ids_orders(spark, folder):
    orders = table(spark, folder, "orders")
    return with_row_id(orders, order_by=["o_orderdate", "o_orderkey"]).select("_row_id", "o_orderkey")


def combined_key_part(spark, folder):
    part = table(spark, folder, "part")
    return part.select("p_partkey", combined_key(part, ["p_name", "p_type", "p_size"]).alias("key"))


def preview_customer(spark, folder):
    return preview(with_row_id(table(spark, folder, "customer"), id_col="c_custkey"), 50)


def common_columns_parties(spark, folder):
    shared = common_columns(*parties(spark, folder))
    a, b = parties(spark, folder)
    return a.select(shared).unionByName(b.select(shared))


# --- exact and fuzzy dedup ---------------------------------------------------------------------

def _trimmed_documents(spark, folder):
    return normalize(table(spark, folder, "documents"), {"text": ["trim", "lowercase"]})


def dedup_exact_documents(spark, folder):
    out = dedup_exact(_trimmed_documents(spark, folder), ["text"], id_col="doc_id")
    return out.clean.select("doc_id", F.md5("text").alias("text"), "lang", "source", "n_chars")


def dedup_exact_audit_documents(spark, folder):
    out = dedup_exact(_trimmed_documents(spark, folder), ["text"], id_col="doc_id")
    return out.audit.withColumn("key", F.md5("key"))


def dedup_exact_events_multi_key(spark, folder):
    events = table(spark, folder, "events")
    return dedup_exact(events, ["user_id", "event_type"], id_col="event_id").clean.drop("_row_id")


def audit_members_events(spark, folder):
    events = table(spark, folder, "events")
    return dedup_exact(events, ["user_id", "event_type"], id_col="event_id").members


def audit_members_from_audit_events(spark, folder):
    events = table(spark, folder, "events")
    return audit_members(dedup_exact(events, ["user_id", "event_type"], id_col="event_id").audit)


def dedup_summary_events(spark, folder):
    events = table(spark, folder, "events")
    return summary(events, dedup_exact(events, ["user_id", "event_type"], id_col="event_id").clean)


def block_pairs_part(spark, folder):
    return block_pairs(
        table(spark, folder, "part"), ["p_name", "p_type"], id_col="p_partkey"
    ).select("block", "id_l", "id_r")


def block_forecast_part(spark, folder):
    part = with_row_id(table(spark, folder, "part"), id_col="p_partkey")
    forecast = pair_forecast(match_keys(part, ["p_name", "p_type"], 1), "block")
    return forecast.withColumn("n_pairs", F.col("n_pairs").cast("bigint"))


def token_sort_ratio_part(spark, folder):
    pairs = block_pairs(table(spark, folder, "part"), ["p_name"], id_col="p_partkey")
    scored = indel_ratio(sorted_tokens(F.col("key_l")), sorted_tokens(F.col("key_r")))
    return pairs.select("key_l", "key_r", F.bround(scored, 6).alias("score"))


def dedup_fuzzy_part(spark, folder):
    part = table(spark, folder, "part")
    out = dedup_fuzzy(part, ["p_name", "p_type"], 85, id_col="p_partkey")
    return out.clean.drop("_row_id")


def dedup_fuzzy_audit_part(spark, folder):
    part = table(spark, folder, "part")
    return dedup_fuzzy(part, ["p_name", "p_type"], 85, id_col="p_partkey").audit


def dedup_fuzzy_audit_urls(spark, folder):
    pages = table(spark, folder, "pages")
    return dedup_fuzzy(pages, ["url"], 90, block_size=8, id_col="page_id").audit


def dedup_fuzzy_customer_names(spark, folder):
    customer = table(spark, folder, "customer")
    return dedup_fuzzy(customer, ["c_name"], 94, id_col="c_custkey").audit


def dedup_fuzzy_levenshtein_part(spark, folder):
    """A scorer that is a column expression."""
    part = table(spark, folder, "part")
    return dedup_fuzzy(
        part, ["p_name", "p_type"], 80, scorer="levenshtein_ratio", block_size=2, id_col="p_partkey"
    ).audit


def dedup_fuzzy_levenshtein_conversations(spark, folder):
    """Whole turns, up to thousands of characters; the table has no key of its own."""
    turns = table(spark, folder, "conversations")
    out = dedup_fuzzy(
        turns, ["role", "text"], 35, scorer="levenshtein_ratio", block_size=13, order_by=["conv_id", "turn"]
    )
    return out.audit.withColumn("key", F.md5("key"))


def dedup_fuzzy_batch_part(spark, folder):
    """A scorer over Arrow batches."""
    scorer = batch_scorer(lambda a, b: pa.array(100.0 * jaro_winklers(a, b)), equal_texts_match=True)
    part = table(spark, folder, "part")
    return dedup_fuzzy(part, ["p_name", "p_type"], 93, scorer=scorer, id_col="p_partkey").audit


def dedup_fuzzy_documents(spark, folder):
    """Whole texts with the product's settings."""
    out = dedup_fuzzy(table(spark, folder, "documents"), ["text"], id_col="doc_id")
    return out.audit.withColumn("key", F.md5("key"))


def dedup_fuzzy_conversations(spark, folder):
    """Whole turns with the product's settings; the table has no key of its own."""
    out = dedup_fuzzy(table(spark, folder, "conversations"), ["text"], order_by=["conv_id", "turn"])
    return out.audit.withColumn("key", F.md5("key"))


def clean_exact_then_fuzzy_part(spark, folder):
    config = {
        "keys": ["p_name", "p_type"], "normalize": {"p_name": ["trim", "lowercase"]},
        "mode": "Exact then Fuzzy", "threshold": 85,
    }
    return clean_table(table(spark, folder, "part"), config, id_col="p_partkey").audit


def audit_union(spark, folder):
    exact = dedup_exact(table(spark, folder, "events"), ["user_id", "event_type"], id_col="event_id")
    probable = dedupe_records(
        table(spark, folder, "documents"), DOCUMENT_CONFIG, id_col="doc_id", model=DOCUMENT_MODEL
    )
    stacked = union_audits(exact.audit, probable.audit)
    return stacked.withColumn("key", F.md5("key"))


# --- comparisons and candidates ----------------------------------------------------------------

def people(spark, folder):
    """Customers as contact records, with an address made from their own columns."""
    handle = F.lower(F.regexp_replace("c_name", "#0*", "."))
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.concat(handle, F.lit("@"), F.lower("c_mktsegment"), F.lit(".example")).alias("email"),
        F.col("c_acctbal").cast("string").alias("phone"),
        F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"),
    )


def _people_levels(spark, folder, kind, column, together=("nation", "segment")):
    """Levels of one comparison over all pairs of people who have ``together`` in common."""
    config = LinkConfig({column: kind}, blocking=("group",))
    grouped = people(spark, folder).withColumn("group", F.concat_ws("/", *together))
    records = cut_lineage(record_rows(with_row_id(grouped, id_col="id"), config).withColumn("copies", F.lit(1)))
    out = candidate_levels(records, None, 1, config)
    return out.select("id_l", "id_r", F.col("gamma_0").alias("gamma"))


def compare_exact_people(spark, folder):
    return _people_levels(spark, folder, "exact", "segment", ["nation"])


def compare_name_people(spark, folder):
    return _people_levels(spark, folder, "name", "name")


def compare_email_people(spark, folder):
    return _people_levels(spark, folder, "email", "email")


def compare_phone_people(spark, folder):
    return _people_levels(spark, folder, "phone", "phone")


def compare_date_orders(spark, folder):
    """Order dates of all pairs of orders of one customer."""
    config = LinkConfig({"day": "date"}, blocking=("o_custkey",))
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    )
    records = record_rows(with_row_id(orders, id_col="o_orderkey"), config).withColumn(
        "copies", F.lit(1)
    )
    out = with_levels(candidate_pairs(records, None, 1), config)
    return out.select("id_l", "id_r", F.col("gamma_0").alias("gamma"))


def _document_records(spark, folder):
    documents = with_row_id(table(spark, folder, "documents"), id_col="doc_id")
    rows = record_rows(documents, DOCUMENT_CONFIG)
    return rows, merge_copies(rows)


def candidate_pairs_documents(spark, folder):
    _, records = _document_records(spark, folder)
    return candidate_pairs(records, None, 2).select(
        "id_l", "id_r", "copies_l", "copies_r", "match_key"
    )


def block_forecast_documents(spark, folder):
    return pair_forecast(table(spark, folder, "documents"), "lang").withColumn(
        "n_pairs", F.col("n_pairs").cast("bigint")
    )


def parties(spark, folder):
    """Customers and suppliers with the columns they share."""
    a = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation"),
        F.floor("c_acctbal").cast("string").alias("balance"), "c_mktsegment",
    )
    b = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nation"),
        F.floor("s_acctbal").cast("string").alias("balance"),
    )
    return a, b


def link_candidates_parties(spark, folder):
    a, b = (
        cut_lineage(merge_copies(record_rows(with_row_id(t, id_col="id"), PARTY_CONFIG)))
        for t in parties(spark, folder)
    )
    return candidate_pairs(a, b, 2, ids_only=True).select("id_l", "id_r", "match_key")


def rule_forecast_documents(spark, folder):
    """How many pairs of documents agree on source, language or length, counted without a pair."""
    config = LinkConfig({"text": "exact"}, blocking=("source", "lang", "n_chars"))
    documents = with_row_id(table(spark, folder, "documents"), id_col="doc_id")
    out = rule_forecast(merge_copies(record_rows(documents, config)), None, 3)
    return out.select("match_key", *(F.col(c).cast("bigint").alias(c) for c in ("equal_pairs", "n_pairs")))


def rule_forecast_parties(spark, folder):
    a, b = (
        merge_copies(record_rows(with_row_id(t, id_col="id"), PARTY_CONFIG))
        for t in parties(spark, folder)
    )
    out = rule_forecast(a, b, 2)
    return out.select("match_key", *(F.col(c).cast("bigint").alias(c) for c in ("equal_pairs", "n_pairs")))


def link_factors_events(spark, folder):
    """Links between records of two kinds of events, not written out to pairs of rows. By the model
    user and step must both be equal."""
    events = table(spark, folder, "events").withColumn("step", F.floor(F.col("value") / 50))
    config = LinkConfig({"user_id": "exact", "step": "exact"}, threshold=0.5)
    model = LinkModel(0.01, config.comparisons, {"user_id": [0.1, 0.9], "step": [0.2, 0.8]},
                      {"user_id": [0.99, 0.01], "step": [0.97, 0.03]})
    a, b = (events.where(F.col("event_type") == kind).select("event_id", "user_id", "step") for kind in ("click", "purchase"))
    out = link_records(a, b, config, "event_id", "event_id", model=model)
    return out.record_links.select(
        "record_a", "record_b", "copies_a", "copies_b", F.col("n_links").cast("bigint").alias("n_links")
    )


# --- training ----------------------------------------------------------------------------------

def prior_documents(spark, folder):
    _, records = _document_records(spark, folder)
    n = records.agg(F.sum("copies")).first()[0]
    patterns = Patterns(blocked_patterns(records, None, DOCUMENT_CONFIG).collect(), 4)
    agreeing = int(patterns.pairs.sum())
    prior = estimate_prior(agreeing, all_pairs_of(n, None))
    return spark.createDataFrame(
        [(agreeing, *agreeing_per_key(patterns, 2), round(prior, 10))],
        "agreeing bigint, equal_text bigint, equal_n_chars bigint, prior double",
    )


def agreement_patterns_documents(spark, folder):
    """How pairs of documents of one source or length agree; a source is on far too many rows for pairs."""
    config = LinkConfig({"lang": "exact", "source": "exact", "n_chars": "exact"}, blocking=("source", "n_chars"))
    records = merge_copies(record_rows(with_row_id(table(spark, folder, "documents"), id_col="doc_id"), config))
    return blocked_patterns(records, None, config).withColumn("pairs", F.col("pairs").cast("bigint"))


def prior_parties(spark, folder):
    a, b = (
        merge_copies(record_rows(with_row_id(t, id_col="id"), PARTY_CONFIG))
        for t in parties(spark, folder)
    )
    patterns = Patterns(blocked_patterns(a, b, PARTY_CONFIG).collect(), 3)
    return spark.createDataFrame(
        [(int(patterns.pairs.sum()), *agreeing_per_key(patterns, 2))],
        "agreeing bigint, equal_nation bigint, equal_balance bigint",
    )


def u_shares_suppliers(spark, folder):
    """All pairs of suppliers: few enough for the sample to be everything."""
    config = LinkConfig(SUPPLIER_KINDS)
    _, b = parties(spark, folder)
    rows = record_rows(with_row_id(b, id_col="id"), config)
    n = rows.count()
    patterns = Patterns(random_patterns(rows, n, None, None, config).collect(), 3)
    equal = equal_pairs(merge_copies(rows), None, ["v0", "v1", "v2"])
    return spark.createDataFrame(
        [(c, k, round(float(s), 8)) for c, u in u_shares(patterns, config, equal).items()
         for k, s in enumerate(u)],
        "comparison string, level int, u double",
    )


def u_shares_sampled_customers(spark, folder):
    """More customers than the bound on random pairs allows: a sample chosen by hash stands in for
    the levels below equality; the share of equality stays exact over all pairs."""
    config = LinkConfig(SUPPLIER_KINDS)
    a, _ = parties(spark, folder)
    rows = record_rows(with_row_id(a, id_col="id"), config)
    patterns = Patterns(random_patterns(rows, rows.count(), None, None, config).collect(), 3)
    equal = equal_pairs(merge_copies(rows), None, ["v0", "v1", "v2"])
    return spark.createDataFrame(
        [(c, k, round(float(s), 8)) for c, u in u_shares(patterns, config, equal).items()
         for k, s in enumerate(u)],
        "comparison string, level int, u double",
    )


def trained_weights_suppliers(spark, folder):
    """Prior, u, m and what they weigh, trained on the suppliers with the product's settings."""
    config = LinkConfig(SUPPLIER_KINDS)
    _, b = parties(spark, folder)
    rows = record_rows(with_row_id(b, id_col="id"), config)
    model = train(merge_copies(rows), rows, None, None, config)
    weights = match_weights(spark, model)
    return weights.select(
        "comparison", "level", "label", F.bround("m", 6).alias("m"), F.bround("u", 6).alias("u"),
        F.bround("bayes_factor", 4).alias("bayes_factor"), F.bround("log2_weight", 5).alias("log2_weight"),
        F.lit(round(model.prior, 8)).alias("prior"),
    )


# --- scoring and results -----------------------------------------------------------------------

def predict_fixed_weights_documents(spark, folder):
    _, records = _document_records(spark, folder)
    needed = needed_agreement(DOCUMENT_CONFIG, DOCUMENT_MODEL, DOCUMENT_CONFIG.threshold)
    pairs = candidate_pairs(cut_lineage(records), None, 2, also_equal=needed)
    return score(pairs, DOCUMENT_CONFIG, DOCUMENT_MODEL, DOCUMENT_CONFIG.threshold).select(
        "id_l", "id_r", "gamma_0", "gamma_1", "gamma_2", "gamma_3",
        F.bround("match_weight", 6).alias("match_weight"),
        F.bround("match_probability", 6).alias("match_probability"),
    )


def cluster_documents(spark, folder):
    """Documents of one source that have a text or a length in common, directly or in steps."""
    documents = table(spark, folder, "documents")
    config = LinkConfig({"text": "exact"}, blocking=("text", "length_in_source"))
    keyed = documents.withColumn("length_in_source", F.concat_ws("/", "source", "n_chars"))
    rows = record_rows(with_row_id(keyed, id_col="doc_id"), config).withColumn(
        "copies", F.lit(1)
    )
    pairs = candidate_pairs(rows, None, 2)
    return connected_components(
        pairs.select(F.col("id_l").alias("src"), F.col("id_r").alias("dst"))
    )


def cluster_all_documents(spark, folder):
    """Every document with its component, alone or not."""
    documents = table(spark, folder, "documents")
    grouped = documents.groupBy("source", "n_chars").agg(F.min("doc_id").alias("src"))
    edges = documents.join(grouped, ["source", "n_chars"]).select("src", F.col("doc_id").alias("dst"))
    return connected_components(edges, documents.select(F.col("doc_id").alias("node")))


def _documents_deduped(spark, folder):
    return dedupe_records(
        table(spark, folder, "documents"), DOCUMENT_CONFIG, id_col="doc_id", model=DOCUMENT_MODEL
    )


def dedupe_prob_audit_documents(spark, folder):
    return _documents_deduped(spark, folder).audit.withColumn("key", F.md5("key"))


def dedupe_prob_clean_documents(spark, folder):
    return _documents_deduped(spark, folder).clean.select("doc_id", "lang", "source", "n_chars")


def dedupe_trained_documents(spark, folder):
    """Training and clustering together."""
    out = dedupe_records(table(spark, folder, "documents"), DOCUMENT_CONFIG, id_col="doc_id")
    return out.audit.withColumn("key", F.md5("key"))


def _parties_linked(spark, folder):
    a, b = parties(spark, folder)
    return link_records(a, b, PARTY_CONFIG, "id", "id", model=PARTY_MODEL)


def link_pairs_parties(spark, folder):
    return _parties_linked(spark, folder).pairs


def link_audit_parties(spark, folder):
    return _parties_linked(spark, folder).audit


def link_trained_parties(spark, folder):
    a, b = parties(spark, folder)
    return link_records(a, b, PARTY_CONFIG, "id", "id").pairs


def dedupe_certain_documents(spark, folder):
    """A threshold that only very sure pairs reach: an empty audit and all rows kept is no error."""
    sure = LinkConfig(
        DOCUMENT_CONFIG.comparisons, threshold=1.0, blocking=DOCUMENT_CONFIG.blocking
    )
    unsure = LinkModel(
        1e-9, DOCUMENT_MODEL.comparisons, DOCUMENT_MODEL.m, DOCUMENT_MODEL.u
    )
    out = dedupe_records(table(spark, folder, "documents"), sure, id_col="doc_id", model=unsure)
    found = out.audit.agg(F.count(F.lit(1)).alias("n_groups"))
    return found.crossJoin(out.clean.agg(F.count(F.lit(1)).alias("n_kept")))


def linkage_plan_documents(spark, folder):
    """The plan as rows, with how many documents have the column that each rule needs."""
    plan = DOCUMENT_CONFIG.plan("dedupe")
    documents = table(spark, folder, "documents")
    rules = F.array(*(
        F.struct(
            F.lit(r["match_key"]).alias("match_key"), F.lit(r["equal"]).alias("equal"),
            F.lit(",".join(r["not_equal"])).alias("not_equal"), F.col(r["equal"]).isNotNull().alias("has"),
        )
        for r in plan["rules"]
    ))
    return documents.select(F.inline(rules)).groupBy("match_key", "equal", "not_equal").agg(
        F.sum(F.col("has").cast("bigint")).alias("n_rows"), F.lit(plan["threshold"]).alias("threshold")
    )


def explain_pairs_documents(spark, folder):
    out = _documents_deduped(spark, folder)
    return explain_pairs(out.scored, out.model).withColumn(
        "log2_weight", F.bround("log2_weight", 6)
    )


# --- sources and sinks -------------------------------------------------------------------------

def _scratch(spark) -> str:
    """A new folder next to the checkpoints."""
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def csv_round_trip_customer(spark, folder):
    path = write_table(table(spark, folder, "customer"), _scratch(spark) + ".csv")
    return read_table(spark, path)


def csv_round_trip_conversations(spark, folder):
    """Texts with quotes and line breaks."""
    path = write_table(table(spark, folder, "conversations"), _scratch(spark) + ".csv")
    return read_table(spark, path, multi_line=True).withColumn("text", F.md5("text"))


def parquet_round_trip_events(spark, folder):
    path = write_table(table(spark, folder, "events"), _scratch(spark) + ".parquet")
    return read_table(spark, path)


def numbered_lineitem(spark, folder):
    """Ids from positions in the files: all of them, without a gap, and the same when read again."""
    path = f"{folder}/lineitem.parquet"
    rows, again = read_numbered(spark, path), read_numbered(spark, path)
    line = F.struct("l_orderkey", "l_linenumber")
    both = rows.select("_row_id", line.alias("line")).join(
        again.select("_row_id", line.alias("line_again")), "_row_id", "full_outer")
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("line") == F.col("line_again")).alias("n_same"),
        F.min("_row_id").alias("least"), F.max("_row_id").alias("greatest"),
        F.count_distinct("_row_id").alias("n_ids"),
    )


def csv_with_schema_customer(spark, folder):
    """One scan: the types are given."""
    customer = table(spark, folder, "customer")
    path = write_table(customer, _scratch(spark) + ".csv")
    return read_table(spark, path, schema=customer.schema)


def written_result_events(spark, folder):
    """Clean rows and audit written next to each other and read again."""
    out = dedup_exact(table(spark, folder, "events"), ["user_id", "event_type"], id_col="event_id")
    clean, audit = (read_table(spark, p) for p in write_result(out.clean, out.audit, _scratch(spark)))
    removed = audit.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_duplicates").alias("n_removed"))
    return removed.crossJoin(clean.agg(F.count(F.lit(1)).alias("n_kept"), F.sum("event_id").alias("sum_ids")))


# --- what is refused, next to what the same call gives for a good configuration -----------------

def _outcomes(spark, schema, cases, run):
    """One row per case: its name, the error's class (null if accepted) and what ``run`` counted."""
    rows = []
    for name, case in cases.items():
        try:
            rows.append((name, None, run(case)))
        except CleaningError as error:
            rows.append((name, type(error).__name__, None))
    return spark.createDataFrame(rows, f"name string, error string, {schema}")


def empty_sources_customer(spark, folder):
    """A file without rows is refused, one with rows is read."""
    customers = table(spark, folder, "customer")

    def run(condition):
        path = write_table(customers.where(condition), _scratch(spark) + ".csv")
        return read_table(spark, path).count()

    cases = {"all": "true", "in debt": "c_acctbal < 0", "none": "c_acctbal > 1e12"}
    return _outcomes(spark, "n_rows bigint", cases, run)


def normalize_checked_customer(spark, folder):
    """Known operations on a known column give text; others are refused before any job."""
    customers = table(spark, folder, "customer")

    def run(config):
        [column] = config
        return normalize(customers, config).agg(F.sum(F.length(column))).first()[0]

    cases = {op: {"c_name": [op]} for op in ("trim", "lowercase", "email", "phone", "uppercase")}
    cases["no such column"] = {"c_email": ["trim"]}
    return _outcomes(spark, "n_chars bigint", cases, run)


def keys_checked_documents(spark, folder):
    """Rows left by exact dedup on each list of keys; no keys and unknown ones are refused."""
    documents = table(spark, folder, "documents")
    cases = {"lang": ["lang"], "lang, source": ["lang", "source"], "none": [], "author": ["author"], "lang, author": ["lang", "author"]}
    return _outcomes(
        spark, "n_kept bigint", cases, lambda keys: dedup_exact(documents, keys, id_col="doc_id").clean.count()
    )


def linkage_configs_documents(spark, folder):
    """Pairs of documents that each linkage would compare; wrong configurations are refused."""
    documents = with_row_id(table(spark, folder, "documents"), id_col="doc_id")

    def run(case):
        config = LinkConfig(**case)
        config.check(documents)
        rows = record_rows(documents, config).withColumn("copies", F.lit(1))
        return candidate_pairs(rows, None, len(config.blocking_columns)).count()

    cases = {
        "good": {"comparisons": {"n_chars": "exact"}},
        "nothing to compare": {"comparisons": {}},
        "unknown comparison": {"comparisons": {"n_chars": "sound"}},
        "unknown column": {"comparisons": {"author": "exact"}},
        "unknown blocking column": {"comparisons": {"n_chars": "exact"}, "blocking": ("author",)},
        "threshold of zero": {"comparisons": {"n_chars": "exact"}, "threshold": 0.0},
    }
    return _outcomes(spark, "n_pairs bigint", cases, run)


def threshold_cap_documents(spark, folder):
    """Pairs found at the threshold that is asked for, at most 0.999, or at the default one."""
    _, records = _document_records(spark, folder)
    records = cut_lineage(records)
    rows = []
    for asked in (None, 0.95, 0.999, 1.0):
        more = {} if asked is None else {"threshold": asked}
        config = LinkConfig(DOCUMENT_CONFIG.comparisons, blocking=DOCUMENT_CONFIG.blocking, **more)
        # pairs that agree on too little to reach the threshold are not made
        needed = needed_agreement(config, DOCUMENT_MODEL, config.threshold)
        pairs = candidate_pairs(records, None, 2, also_equal=needed)
        found = score(pairs, config, DOCUMENT_MODEL, config.threshold).count()
        rows.append((asked, config.threshold, config.seed, found))
    return spark.createDataFrame(rows, "asked double, threshold double, seed bigint, n_pairs bigint")


def training_refusals_documents(spark, folder):
    """A prior where there is something to learn from; one clear error where there is not."""
    documents = with_row_id(table(spark, folder, "documents"), id_col="doc_id")

    def run(config):
        rows = record_rows(documents, config)
        return round(train(merge_copies(rows), rows, None, None, config).prior, 10)

    cases = {
        "good": LinkConfig({"n_chars": "exact", "source": "exact", "lang": "exact"}, blocking=("n_chars",)),
        "no equal values": LinkConfig({"doc_id": "exact", "lang": "exact"}, blocking=("doc_id",)),
        "nothing but the block": LinkConfig({"source": "exact"}),
    }
    return _outcomes(spark, "prior double", cases, run)


QUERIES = {
    f.__name__: f
    for f in (
        profile_summary_events, profile_dup_rows_part, profile_columns_labelled_documents,
        normalize_customer_name, normalize_email_like_urls, normalize_phone_digits_documents,
        normalize_trim_documents, normalize_nulls_labelled_documents, row_ids_orders, combined_key_part, preview_customer,
        common_columns_parties,
        dedup_exact_documents, dedup_exact_audit_documents, dedup_exact_events_multi_key,
        audit_members_events, audit_members_from_audit_events, dedup_summary_events,
        block_pairs_part, block_forecast_part, block_forecast_documents, token_sort_ratio_part,
        dedup_fuzzy_part, dedup_fuzzy_audit_part, dedup_fuzzy_audit_urls,
        dedup_fuzzy_customer_names, dedup_fuzzy_levenshtein_part,
        dedup_fuzzy_levenshtein_conversations, dedup_fuzzy_batch_part, dedup_fuzzy_documents, dedup_fuzzy_conversations,
        clean_exact_then_fuzzy_part, audit_union,
        compare_exact_people, compare_name_people, compare_email_people, compare_phone_people,
        compare_date_orders, candidate_pairs_documents, link_candidates_parties, rule_forecast_documents,
        rule_forecast_parties, link_factors_events,
        prior_documents, prior_parties, agreement_patterns_documents, u_shares_suppliers, u_shares_sampled_customers,
        trained_weights_suppliers,
        predict_fixed_weights_documents, cluster_documents, cluster_all_documents, dedupe_prob_audit_documents,
        dedupe_prob_clean_documents, dedupe_trained_documents, link_pairs_parties,
        link_audit_parties, link_trained_parties, dedupe_certain_documents, linkage_plan_documents,
        explain_pairs_documents, csv_round_trip_customer, csv_round_trip_conversations,
        parquet_round_trip_events, csv_with_schema_customer, written_result_events,
        numbered_lineitem, empty_sources_customer, normalize_checked_customer, keys_checked_documents,
        linkage_configs_documents, threshold_cap_documents, training_refusals_documents,
    )
}
