import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry_module  # noqa: E402
from tools.check import TABLES, rows_of  # noqa: E402

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()

INVENTORY = """
src_csv src_multi src_prune src_guard src_required src_alias src_optional src_audit src_request snk_table snk_splits
snk_matrix snk_model snk_metrics txt_clean txt_strip lbl_norm lbl_numeric lbl_flip lbl_name txt_combine txt_spaphish
txt_message txt_prompt txt_verdict txt_norm txt_hash txt_len txt_truncate num_clean num_finite txt_entropy
url_extract_live url_extract_list url_extract_text url_extract_test url_count url_explode url_canon url_domain
url_regdomain url_features_table url_features_alt flt_label flt_label01 flt_text flt_threshold flt_argmax flt_class
dd_text_label dd_url_label dd_hash_first dd_count set_union set_overlap_hash set_overlap_id set_overlap_domain jn_label
jn_hstack jn_scores agg_label_counts agg_source_counts agg_class_pct agg_crosstab agg_null_counts agg_label_candidates
agg_shape_preview agg_len_stats agg_len_quantiles agg_len_buckets agg_distinct_urls agg_url_conflicts agg_vec_dups
agg_vec_conflicts agg_domain_stats agg_url_max agg_describe win_seq_id srt_importance srt_topk spl_80_10_10 spl_70_15_15
spl_70_10_20 spl_group spl_sample_class tfidf_fit tfidf_transform tfidf_stats svd_fit svd_transform svd_explained
vec_assemble vec_scale mdl_url mdl_url_plus mdl_learning_curve mdl_importance mdl_text mdl_text_score mdl_url_score
mdl_fusion mdl_coefficients mdl_select_best sc_fixed_fusion sc_level sc_response sc_email sc_multimodal sc_fusion_set
ev_confusion ev_binary ev_auc ev_report ev_logloss ev_verdict st_score st_dedupe
""".split() + [f"f{i:02d}" for i in range(1, 26)]


def test_every_operator_is_registered():
    assert not set(INVENTORY) - set(QUERIES)
    assert not set(ORACLES) - set(QUERIES)


def test_flagship(spark):
    df = entry_module.entry(spark)
    assert df.count() == 50 and len(df.columns) == 27


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cursor = duck.execute(ORACLES[name])
    names, want = [d[0] for d in cursor.description], cursor.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, want)
    assert not any(isinstance(v, float) and math.isnan(v) for r in want for v in r)


def test_models_have_their_full_size():
    from hookline.operators import url_model

    assert (url_model.TREES, url_model.DEPTH) == (500, 8)
