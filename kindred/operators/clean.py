"""The staged cleaning run: normalise, then exact and/or fuzzy dedup, one audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from kindred.config import CleanConfig
from kindred.errors import require_columns
from kindred.operators.audit import DedupResult, drop_rows
from kindred.operators.exact import exact_rows
from kindred.operators.fuzzy import FuzzySettings, fuzzy_rows
from kindred.operators.normalize import normalize
from kindred.plans.cut import cut_lineage
from kindred.plans.ids import ROW_ID, quoted, with_row_id


def clean_table(
    df: DataFrame, config: CleanConfig | dict, id_col: str | None = None,
    order_by: str | list[str] | None = None, trusted: bool = False,
) -> DedupResult:
    """Row ids stay those of the input through both stages, and groups of the second stage are
    numbered on from the first. A row the exact stage kept may be removed by the fuzzy stage;
    both audits then say so."""
    config = CleanConfig.of(config)
    require_columns(df, config.keys, "Key column")
    rows = normalize(with_row_id(df, order_by, id_col, trusted), config.normalize)
    keys = list(config.keys)
    if config.mode == "exact":
        return exact_rows(rows, keys)
    settings = FuzzySettings(config.threshold, config.scorer, config.block_size)
    if config.mode == "fuzzy":
        return fuzzy_rows(rows, keys, settings)
    exact = exact_rows(rows, keys)
    # the second stage looks at the first's survivors as ids and key columns, written once; whole
    # rows move in one anti join on what both stages removed
    kept = cut_lineage(drop_rows(rows.select(ROW_ID, *map(quoted, keys)), ROW_ID, exact.groupings[0].removed))
    fuzzy = fuzzy_rows(kept, keys, settings)
    groupings = [*exact.groupings, *fuzzy.groupings]
    removed = reduce(DataFrame.unionByName, [g.removed.select("removed_index") for g in groupings])
    return DedupResult(drop_rows(rows, ROW_ID, removed), *groupings)
