"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and is then timed over ``$BENCH_RUNS`` runs (median), fewer once it has taken
``$BENCH_SECONDS``. Results go to Spark's no-op sink, so
every row is computed and none is gathered. ``python bench.py name ...`` times only the queries named.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from taleweave.plans.catalog import QUERIES  # noqa: E402
from taleweave.session import local_session  # noqa: E402

HEADLINE = [
    "agg_class_weights",
    "smp_split3",
    "smp_balance_down",
    "prj_text_cloze",
    "prj_row_index",
    "agg_length_histogram",
    "evl_split_report",
    "los_cross_entropy",
    "tok_tokenize",
    "tok_vocab_encode",
    "tok_pack_blocks",
    "tok_next_pairs",
    "smp_topk_tokens",
    "dec_top_p",
    "lm_perplexity",
    "pho_metaphone",
    "pho_pair_similarity",
    "txt_bleu",
    "txt_rouge_l",
    "txt_meteor",
    "mlj_category",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    enough = float(os.environ.get("BENCH_SECONDS", "10"))
    spark = local_session(cpus, app="bench")
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        laps = []
        for lap in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            if lap:
                laps.append(time.perf_counter() - start)
            if sum(laps) > enough:
                break
        times[name] = round(statistics.median(laps), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
