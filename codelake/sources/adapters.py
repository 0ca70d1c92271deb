"""Engine tables made from the driver's tables, in SQL that Spark and DuckDB both run.

A text uses {table} for a driver's table and for an earlier adapter; DuckDB gets them as common table expressions, Spark as DataFrames.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

ADAPTERS: dict[str, str] = {
    # Entities: a document is one; the same name in the same file is one entity, the last wins.
    "ent": """
SELECT repo_id, file, name, type, start_line, end_line, raw_code, concat_ws('::', repo_id, file, name) AS uid
FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file, name ORDER BY doc_id DESC) AS rn
      FROM (SELECT doc_id, source AS repo_id, concat('f', CAST(doc_id % 7 AS STRING), '.', lang) AS file, lower(split_part(text, ' ', 2)) AS name,
                   CASE doc_id % 5 WHEN 0 THEN 'Class' WHEN 4 THEN 'Variable' ELSE 'Function' END AS type,
                   CAST(doc_id % 500 AS INT) AS start_line, CAST(doc_id % 500 + doc_id % 50 AS INT) AS end_line, text AS raw_code
            FROM {documents} WHERE text IS NOT NULL AND source IS NOT NULL) AS x) AS y
WHERE rn = 1""",
    # Edges at scale: suppliers call parts; files are nations and brands.
    "edges": """
SELECT DISTINCT concat('s', CAST(s_nationkey % 5 AS STRING)) AS repo_id, concat('n', CAST(s_nationkey AS STRING)) AS src_file, CAST(l_suppkey AS BIGINT) AS src, p_brand AS dst_file, CAST(l_partkey AS BIGINT) AS dst
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey""",
    "chunks": """
SELECT CAST(vec_id AS BIGINT) AS id, concat('r', CAST(label AS STRING)) AS repo_id, concat('f', CAST(vec_id % 13 AS STRING), '.py') AS file, concat('fn', CAST(vec_id AS STRING)) AS name,
       CASE WHEN vec_id % 3 = 0 THEN 'Class' ELSE 'Function' END AS type, CAST(vec_id % 97 AS INT) AS start_line, embedding
FROM {embeddings} WHERE embedding IS NOT NULL""",
    # One template line per kind of rule, and clean ones, dealt over blocks by user.
    "code_lines": """
SELECT block, CAST(row_number() OVER (PARTITION BY block ORDER BY event_id) AS INT) AS line_no, language, line
FROM (SELECT user_id AS block, event_id, CASE user_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'java' WHEN 3 THEN 'go' ELSE 'ts' END AS language,
      CASE event_id % 52
        WHEN 0 THEN 'x = eval(data)' WHEN 1 THEN 'os.exec (cmd)' WHEN 2 THEN 'm = __import__(name)' WHEN 3 THEN 'password = "x"' WHEN 4 THEN 'api_key="k"'
        WHEN 5 THEN 'SECRET = "s"' WHEN 6 THEN 'token = "abcdefghijklmnopqrst0"' WHEN 7 THEN 'el.innerHTML = v' WHEN 8 THEN '<b dangerouslySetInnerHTML=v/>'
        WHEN 9 THEN 'document.write(v)' WHEN 10 THEN 'execute("select %s", v)' WHEN 11 THEN 'query(f"select")' WHEN 12 THEN 'u = "a" + request.path' WHEN 13 THEN 'open(a + b)'
        WHEN 14 THEN 'readFile(a + b' WHEN 15 THEN 'h = md5(v)' WHEN 16 THEN 'h = sha1 (v)' WHEN 17 THEN 'pickle.loads(v)' WHEN 18 THEN 'yaml.load(v)'
        WHEN 19 THEN 'for i in range(len(v)):' WHEN 20 THEN '[a for a in b if c] + [d for d in e]' WHEN 21 THEN '    out.append(v)' WHEN 22 THEN '    except:'
        WHEN 23 THEN 'except Exception: pass' WHEN 24 THEN 'print(v)' WHEN 25 THEN 'console.log(v)' WHEN 26 THEN 'debugger;' WHEN 27 THEN 'var x = 1' WHEN 28 THEN 'if a == b:'
        WHEN 29 THEN '# TODO: later' WHEN 30 THEN 'from * import a' WHEN 31 THEN 'if type(v) == int:' WHEN 32 THEN 'if len(v) == 0:' WHEN 33 THEN 'd.has_key(v)' WHEN 34 THEN 'except A, e:'
        WHEN 35 THEN 'a = new Array()' WHEN 36 THEN 'o = new Object()' WHEN 37 THEN 'el.innerHTML += v' WHEN 38 THEN 'for (var k in o)' WHEN 39 THEN 'setTimeout(f, 0)'
        WHEN 40 THEN '$(a).b(c).d(e).f' WHEN 41 THEN 'System.out.println(v)' WHEN 42 THEN 'e.printStackTrace()' WHEN 43 THEN 's = new String(v)' WHEN 44 THEN 's = a + "" + b'
        WHEN 45 THEN 'panic(err)' WHEN 46 THEN '_ = f(err)' WHEN 47 THEN '                        deep = v' WHEN 48 THEN '' WHEN 49 THEN '  # note' WHEN 50 THEN 'while a && b || c' ELSE 'total = total + v' END AS line
      FROM {events}) AS x""",
    # A Python statement per event; a user's make a block.
    "py_rows": """
SELECT user_id AS block, event_id AS pos, CAST(event_id % 8 AS INT) AS kind,
       CASE event_id % 8 WHEN 0 THEN 'if a and b or c: x = 1' WHEN 1 THEN 'for i in y: pass' WHEN 2 THEN 'while a or b: break' WHEN 3 THEN 'x = 1 if a else 2'
         WHEN 4 THEN 'def f(v): return v and v' WHEN 5 THEN 'total = total + 1' WHEN 6 THEN concat('try: x = int(y)', chr(10), 'except ValueError: x = 0') ELSE 'y = [i for i in z if i]' END AS line
FROM {events}""",
    # A unified diff per order: its lines are added, removed or kept by their return flag.
    "patch_rows": """
SELECT l_orderkey AS pr, concat('src/', lower(o_orderpriority), '.py') AS filename, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS pos,
       concat(CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE ' ' END, 'part_', CAST(l_partkey AS STRING), ' = ', CAST(l_suppkey AS STRING)) AS line, l_orderkey % 90 + 1 AS hunk_start
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "patches": """
SELECT pr, min(filename) AS filename, concat('@@ -', CAST(min(hunk_start) AS STRING), ',', CAST(count(*) AS STRING), ' +', CAST(min(hunk_start) AS STRING), ',', CAST(count(*) AS STRING), ' @@\n',
       {join_lines}) AS patch
FROM {patch_rows} GROUP BY pr""",
    "pr_files": """
SELECT o_custkey AS pr, concat('f', CAST(o_orderkey AS STRING), CASE o_orderkey % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.go' WHEN 3 THEN '.min.js' WHEN 4 THEN '.java' ELSE '.md' END) AS filename,
       CASE o_orderstatus WHEN 'F' THEN 'removed' WHEN 'O' THEN 'modified' ELSE 'added' END AS status,
       CAST(o_orderkey % 300 AS INT) AS additions, CAST(o_orderkey % 120 AS INT) AS deletions,
       CASE o_orderkey % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'go' WHEN 4 THEN 'java' ELSE 'unknown' END AS language
FROM {orders}""",
    # Issues of review runs, from the events of a user.
    "issues": """
SELECT CAST(event_id AS BIGINT) AS idx, user_id AS pr, concat('f', CAST(event_id % 11 AS STRING), '.py') AS filename,
       CASE event_id % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' WHEN 5 THEN 'medium' ELSE 'low' END AS severity,
       CASE event_id % 4 WHEN 0 THEN 'security' WHEN 1 THEN 'code_quality' WHEN 2 THEN 'performance' ELSE 'maintainability' END AS category,
       concat('issue ', CAST(event_id AS STRING), CASE WHEN event_id % 3 = 0 THEN ' of Security' ELSE '' END) AS description, CAST(event_id % 40 AS INT) AS line
FROM {events}""",
    "requests": """
SELECT CAST(event_id AS BIGINT) AS id, user_id AS installation, event_type AS endpoint, ts, CAST(1 + event_id % 3 AS BIGINT) AS tokens FROM {events}""",
    "reviews": """
SELECT CAST(event_id AS BIGINT) AS review_id, user_id AS pr, ts AS created_at, CAST(round(value * 100) AS BIGINT) AS score, CAST(event_id % 23 AS BIGINT) AS files, CAST(event_id % 41 AS BIGINT) AS issues,
       CAST(event_id % 3 AS BIGINT) AS critical, CAST(event_id % 5 AS BIGINT) AS high, CAST(event_id % 7 AS BIGINT) AS medium, CAST(event_id % 11 AS BIGINT) AS low
FROM {events} WHERE event_type IN ('error', 'purchase')""",
    "prs": """
SELECT o_custkey AS pr, count(*) AS files, CAST(sum(o_orderkey % 300) AS BIGINT) AS additions, CAST(sum(o_orderkey % 120) AS BIGINT) AS deletions,
       CAST(max(o_orderkey) % 4 AS BIGINT) AS critical, CAST(max(o_orderkey) % 7 AS BIGINT) AS high, CAST(max(o_orderkey) % 2 AS BIGINT) AS security_critical, CAST(max(o_orderkey) % 3 AS BIGINT) AS security_high,
       CAST(max(o_orderkey) % 29 AS BIGINT) AS callers, CAST(max(o_orderkey) % 9 AS BIGINT) AS quality, max(o_orderkey) % 5 = 0 AS coupled, CAST(max(o_orderkey) % 3 AS BIGINT) AS complex_files, max(o_orderkey) % 8 = 0 AS deep
FROM {orders} GROUP BY o_custkey""",
}

_SPARK_PARTS = {"join_lines": "array_join(transform(array_sort(collect_list(struct(pos, line))), x -> x.line), '\\n')"}
_DUCK_PARTS = {"join_lines": "string_agg(line, chr(10) ORDER BY pos)"}
_NAME = re.compile(r"\{(\w+)\}")


def _needs(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(_NAME.findall(sql)) if n in ADAPTERS or n in TABLES]


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table or an adapter as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return run_sql(spark, sf_dir, ADAPTERS[name])


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Spark SQL with {names} of tables and adapters."""
    for part, text in _SPARK_PARTS.items():
        sql = sql.replace("{" + part + "}", text)
    return spark.sql(sql, **{n: source(spark, sf_dir, n) for n in _needs(sql)})


def oracle(sql: str, **more: str) -> str:
    """DuckDB SQL: every {adapter} that the text or another adapter names becomes a common table expression; more: further ones, in order."""
    made: dict[str, str] = {}

    def add(name: str, text: str) -> None:
        if name in made or name in TABLES:
            return
        for n in dict.fromkeys(_NAME.findall(text)):
            if n in ADAPTERS or n in more:
                add(n, more.get(n) or ADAPTERS[n])
        made[name] = text

    for n in dict.fromkeys(_NAME.findall(sql)):
        if n in ADAPTERS or n in more:
            add(n, more.get(n) or ADAPTERS[n])

    def plain(text: str) -> str:
        for part, own in _DUCK_PARTS.items():
            text = text.replace("{" + part + "}", own)
        return _NAME.sub(r"\1", text).replace("' @@\n'", "' @@' || chr(10)")

    ctes = ", ".join(f"{n} AS MATERIALIZED ({plain(t)})" for n, t in made.items())
    return (f"WITH RECURSIVE {ctes} " if ctes else "") + plain(sql)
