"""JSON in, JSON out: ``echo '{"dates": [...], "prices": [...]}' | python -m tidemark.cli``.

Prints the decennial analysis of one series. An error becomes {"error": ...} and exit 1.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import functions as F

from .operators import bars, seasonality
from .session import session


def answer(request: dict) -> dict:
    spark = session("cli", request.get("master"))
    rows = [(request.get("symbol", "series"), d, float(p)) for d, p in zip(request["dates"], request["prices"], strict=True)]
    frame = spark.createDataFrame(rows, "series_id string, time string, close double").withColumn("time", F.to_date("time"))
    found = seasonality.decennial(bars.numbered(frame), int(request["current_year"]), int(request.get("min_years", 30)), request.get("asset_type", "stock"))
    return json.loads(found.toJSON().first() or "{}")


def main() -> int:
    try:
        print(json.dumps(answer(json.load(sys.stdin))))
    except (KeyError, TypeError, ValueError) as error:
        print(json.dumps({"error": f"{type(error).__name__}: {error}"}))
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
