"""Timelines keyed by ws, made from the given star-schema tables.

Each view is one SELECT that Spark and DuckDB read alike; `{name}` stands for
an input table or an earlier view. Values lie on a binary grid (k/2 .. k/128),
so that sums and rounding do not depend on their order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import saved

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    # one row per user's event, in order of time
    "v_event": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {events}",
    "v_loud": "SELECT user_id AS ws, n - 1 AS idx, (n - 1) * 0.5e0 AS t, CASE WHEN event_id % 41 = 0 THEN NULL ELSE -60e0 + floor(value) / 8e0 END AS db FROM {v_event}",
    "v_scene": "SELECT user_id AS ws, n - 1 AS idx, (n - 1) * 0.25e0 AS t, floor(least(value, 128e0)) / 128e0 AS score FROM {v_event}",
    "v_color": "SELECT user_id AS ws, (n - 1) * 0.375e0 AS t, floor(least(value * 0.5e0, 100e0)) / 128e0 AS distance FROM {v_event}",
    "v_hits": "SELECT user_id AS ws, event_type AS label, n * 1.5e0 + (event_id % 5) AS t, floor(least(value, 100e0)) / 100e0 AS conf FROM {v_event}",
    "v_cp_log": """SELECT user_id AS ws, n AS line_no,
        concat('cp-', lpad(cast(cast(regexp_extract(props, '([0-9]+)', 1) AS int) % 20 AS string), 3, '0')) AS cp_id,
        CASE event_type WHEN 'purchase' THEN 'verified' WHEN 'error' THEN 'corrected' WHEN 'signup' THEN 'hypothesized' WHEN 'view' THEN 'hypothesized' ELSE 'draft' END AS status,
        cast((event_id * 7) % 600 AS double) AS s, cast((event_id * 7) % 600 + (event_id % 13) AS double) AS e, 600e0 AS duration,
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE floor(least(value, 100e0)) / 128e0 END AS confidence,
        event_id % 3 AS has_ve, event_id, concat('claim ', event_type) AS hypothesis FROM {v_event}""",
    "v_videos": "SELECT DISTINCT user_id AS ws, 600e0 AS duration, concat('grp', cast(user_id % 7 AS string)) AS grp FROM {events}",
    "v_seg": "SELECT conv_id AS ws, turn AS pos, 6e0 * turn AS s, 6e0 * turn + 0.5e0 + (length(text) % 48) / 8e0 AS e, role, text, CASE WHEN length(text) % 5 = 0 THEN NULL ELSE (length(text) % 16) / 16e0 END AS conf, -(length(text) % 12) / 8e0 AS logprob, (length(text) % 8) / 8e0 AS no_speech_prob FROM {conversations}",
    "v_turns": "SELECT conv_id AS ws, turn AS pos, 6e0 * turn - 2e0 AS s, 6e0 * turn + 3e0 AS e, concat(role, cast(turn % 3 AS string)) AS speaker FROM {conversations}",
    "v_edge": "SELECT DISTINCT o.o_custkey AS subj, l.l_returnflag AS pred, l.l_partkey AS obj FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey",
    "v_label": "SELECT DISTINCT l.l_suppkey AS ws, p.p_name AS label FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey",
    "v_cuts": """SELECT user_id AS ws, concat('seq-', lpad(cast(1 + (n - 1) // 6 AS string), 3, '0')) AS seq_id, (n - 1) % 6 + 1 AS ord,
        cast((event_id * 7) % 590 AS double) AS s, cast((event_id * 7) % 590 + 2 + event_id % 9 AS double) AS e,
        concat('cp-', lpad(cast(event_id % 20 AS string), 3, '0')) AS cp_id, event_id FROM {v_event}""",
    "v_image_events": """SELECT user_id AS ws, n AS line_no, concat('frames/t', lpad(cast(event_id % 97 AS string), 9, '0'), '.jpg') AS path,
        concat('edge-', cast(event_id % 700 AS string)) AS edge_id, concat('cp-', lpad(cast(event_id % 20 AS string), 3, '0')) AS cause_id, event_type AS reason,
        CASE WHEN event_id % 4 = 0 THEN NULL ELSE cast(event_id % 97 AS double) END AS t, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS kind FROM {v_event}""",
    "v_motion": "SELECT ws, idx, t, 'left' AS roi, 0 AS roi_order, floor(score * 16e0) / 16e0 AS motion FROM {v_scene} UNION ALL SELECT ws, idx, t, 'right', 1, cast((idx * 7) % 11 AS double) / 16e0 FROM {v_scene}",
    "v_files": "SELECT l_suppkey AS ws, concat(CASE l_linenumber % 5 WHEN 0 THEN 'clips/a' WHEN 1 THEN 'cache/b' WHEN 2 THEN 'frames/c' WHEN 3 THEN 'd' ELSE 'e' END, cast(l_orderkey AS string), CASE l_linenumber % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.jpg' ELSE '.json' END) AS path, cast(l_quantity * 1000 AS bigint) AS size, cast(l_shipdate AS date) AS mtime FROM {lineitem}",
}

#: Views over words; Spark and DuckDB number the items of an array in different ways.
VIEWS["v_words"] = "SELECT conv_id AS ws, turn AS pos, k, word, 6e0 * turn + 0.25e0 * k AS s, 6e0 * turn + 0.25e0 * k + 0.1875e0 AS e, (length(word) % 8) / 8e0 AS p FROM (SELECT conv_id, turn, posexplode(split(text, ' ')) AS (k, word) FROM {conversations}) WHERE word <> ''"
VIEWS["v_links"] = "SELECT page_id AS page, target FROM (SELECT page_id, explode(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM {pages})"
DUCK = {
    "v_words": "SELECT conv_id AS ws, turn AS pos, k, w[k + 1] AS word, 6e0 * turn + 0.25e0 * k AS s, 6e0 * turn + 0.25e0 * k + 0.1875e0 AS e, (length(w[k + 1]) % 8) / 8e0 AS p FROM (SELECT conv_id, turn, w, unnest(range(len(w))) AS k FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM {conversations})) WHERE w[k + 1] <> ''",
    "v_links": "SELECT page_id AS page, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM {pages}",
}


def resolved(name: str) -> list[str]:
    """The views that `name` needs, itself last, each once, in order."""
    out: list[str] = []
    for x in re.findall(r"\{(\w+)\}", VIEWS[name]):
        if x in VIEWS:
            out += [v for v in resolved(x) if v not in out]
    return [*out, name]


def view(spark: SparkSession, sf_dir: str, name: str, held: dict[str, DataFrame] | None = None) -> DataFrame:
    """An input table or view; views in `held` are taken from there."""
    if held and name in held:
        return held[name]
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inputs = {x: view(spark, sf_dir, x, held) for x in re.findall(r"\{(\w+)\}", VIEWS[name])}
    return spark.sql(VIEWS[name].replace("//", "div"), **inputs)


class Views:
    """The inputs of one query by name. What `keep` was called for is written once and serves all views over it."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.held: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name, self.held)

    def keep(self, name: str) -> None:
        if name not in self.held:
            self.held[name] = saved(self(name), name)


def with_views(sql: str) -> str:
    """DuckDB SQL over views: a query that names them, with their definitions ahead of its own WITH clauses."""
    names: list[str] = []
    for x in re.findall(r"\bv_\w+", sql):
        if x in VIEWS:
            names += [v for v in resolved(x) if v not in names]
    heads = [f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', DUCK.get(n, VIEWS[n]))})" for n in names]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join([*heads, body[15:]])}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(heads)}, {body[5:]}" if heads else body
    return f"WITH {', '.join(heads)} {body}" if heads else body
