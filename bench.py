"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seedloom.plans.registry import spark_queries  # noqa: E402
from seedloom.session import local_session  # noqa: E402

# One or two per family of operators.
HEADLINE = (
    "a17_position_differential a11_distribution_metrics a12_gene_metrics a14_mann_whitney a15_bh_adjust "
    "w01_sliding_windows w03_effective_intervals w04_overlap_join w08_intervals_to_bases "
    "a02_nonzero_mean_by_chrom a04_renormalise a05_average_tracks a06_weighted_quantile a09_gene_signal_mean a51_coverage "
    "a22_regression_metrics a23_zero_inflated_metrics a24_per_window_metrics a26_distribution_compare a36_token_f1 a48_rank_time_report "
    "c01_split_sentences c02_tokenise c07_pack_sequences c09_lm_example c11_blend_exhaustive c19_chunk_documents c22_sft_examples c23_pack_knapsack "
    "f02_average_rank f06_running_sum f07_global_prefix_sum f08_gaussian_smooth j03_sum_directions j08_knn_join "
    "s01_read_fasta s05_signal_tables u03_first_wins x01_reverse_complement x04_apply_variants"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "seedloom-bench")
    queries = spark_queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
