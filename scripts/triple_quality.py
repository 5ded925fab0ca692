"""Fit on labelled (left, right, gt) CSV triples; print P/R/F1 and seconds.

usage: python scripts/triple_quality.py DIR [NAME...]
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from fuzzyspark.operators import evaluate as E  # noqa: E402
from fuzzyspark.operators import model as M  # noqa: E402
from fuzzyspark.session import get_session  # noqa: E402
from fuzzyspark.sources import io  # noqa: E402

def main():
    root = sys.argv[1]
    spark = get_session("local[8]")
    for name in sys.argv[2:] or sorted(os.listdir(root)):
        d = os.path.join(root, name)
        if not os.path.exists(os.path.join(d, "left.csv")):
            continue
        left, right, gt = io.load_triple(spark, d)
        t0 = time.time()
        model, res = M.fit(left, right, "id")
        pred = res.select(F.col("id_l"), F.col("id_r")).cache()
        n = pred.count()
        sc = E.evaluate(gt, pred)
        print(json.dumps({"dataset": name, "seconds": round(time.time() - t0, 1), "matches": n,
                          "precision_est": model.precision_est, "configs": len(model.configs or []),
                          **{k: round(v, 4) for k, v in sc.items()}}), flush=True)


if __name__ == "__main__":
    main()
