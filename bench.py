"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from tracemill import session
from tracemill.plans import REGISTRY

HEADLINES = (
    "timeline_page",
    "timeline_wildcard",
    "conversation_with_tools",
    "page_info",
    "project_status",
    "recent_sessions",
    "find_session",
    "project_by_path",
    "resolve_projects",
    "topics",
    "session_topics",
    "latest_contents",
    "file_history",
    "accessed_files",
    "read_snapshots",
    "replay_edits",
    "usage_report",
    "usage_by_session",
    "provider_usage_by_model",
    "search_phrase",
    "search_or",
    "search_many",
    "errors",
    "doc_fts",
    "doc_like",
    "fused_search",
    "redact",
    "redact_manifest",
    "session_events",
    "transcript_events",
    "tree_events",
    "git_commits",
    "append_new",
    "upsert",
    "stream_daily_tokens",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session.local(int(os.environ.get("BENCH_CPUS", "8")))
    REGISTRY["timeline_page"].run(spark, sf_dir).collect()  # warm-up
    times = {}
    for name in sys.argv[1:] or HEADLINES:
        start = time.time()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall-clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
