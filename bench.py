"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR  driver data (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from checks import load  # noqa: E402
from checks.documents import requests_for_all  # noqa: E402
from stockloom.model import SCHEMAS  # noqa: E402
from stockloom.plans import documents, views  # noqa: E402
from stockloom.session import local_session, shared_folder, staged  # noqa: E402
from stockloom.sources.fixtures import derived_tables  # noqa: E402
from stockloom.streaming.refresh import document_table, stored_documents  # noqa: E402

AS_OF = "2024-06-30"


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    seconds: dict[str, float] = {}
    rows: dict[str, int] = {}

    def timed(name, build):
        started = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)

    started = time.perf_counter()
    t = derived_tables(spark, folder)
    for name in SCHEMAS:
        t[name]
    load_seconds = round(time.perf_counter() - started, 3)

    document = documents.to_document(documents.order_fulfillment_doc(t), requests_for_all(t), F.lit("2024-07-01").cast("timestamp"))
    stored = staged(document, "bench-documents")
    rows["v19_documents"] = stored.count()
    by_key = document_table(spark, f"{shared_folder(spark)}/stockloom/{spark.sparkContext.applicationId}/bench-by-key", stored.schema)
    by_key.put(stored, 0)
    keys = {n: staged(stored.select("_id").limit(n), "bench-keys") for n in (100, 10_000)}
    rows["v15_running_ledger"] = t["inventory_tx"].count()
    timed("v19_documents", lambda: documents.order_fulfillment_doc(t))
    timed("v19_stored_documents", lambda: stored)
    timed("s04_lookup_10000_keys", lambda: stored_documents(by_key, keys[10_000]))
    timed("s04_lookup_100_keys", lambda: stored_documents(by_key, keys[100]))
    timed("v19_documents_of_100_keys", lambda: documents.order_fulfillment_doc(t, keys[100]))
    timed("v06_available", lambda: views.inventory_available(t))
    timed("v07_po_lines", lambda: views.po_line_open(t))
    timed("v10_so_lines", lambda: views.so_line_open(t))
    timed("v12_shipments", lambda: views.shipment_detail(t))
    timed("v15_running_ledger", lambda: views.inventory_tx_running(t))
    timed("v17_bom_explosion", lambda: views.bom_flat_active(t, F.lit(AS_OF).cast("date")))
    timed("b08_post_movements", lambda: registry.QUERIES["b08_post_movements"](spark, folder))
    timed("b06_reserve_stock", lambda: registry.QUERIES["b06_reserve_stock"](spark, folder))
    timed("b11_ship_status", lambda: registry.QUERIES["b11_ship_status"](spark, folder))
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")), "load_tables_sec": load_seconds,
        "rows_per_sec": {name: round(n / seconds[name]) for name, n in rows.items()},
        "ms_per_document": round(1000 * seconds["v19_documents"] / rows["v19_documents"], 4),
        "ms_per_document_by_key": round(1000 * seconds["s04_lookup_10000_keys"] / min(10_000, rows["v19_documents"]), 4),
    }))


if __name__ == "__main__":
    main()
