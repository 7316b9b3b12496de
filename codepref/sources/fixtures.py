"""Derived fixture views over the driver tables.

The test data holds prose, not code, so the code operators run on views that
SQL derives from ``documents`` / ``conversations`` (they grow with the data).
Each view is one SQL template that runs unchanged in Spark and DuckDB:
``{documents}`` style placeholders name the inputs, ``{{`` / ``}}`` are
literal braces. Spark binds the placeholders to DataFrames
(``spark.sql(text, documents=df)``); the oracle binds them to plain table
names and inlines the views as CTEs.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codepref.sources.tables import read_table

# The derived views. Every row holds the whole text of its
# document: the first line (for each tenth row all lines) is the documentation,
# the other lines are code, as comments, list items, calls or conditions. Residues
# of row_id choose names, parameters, tags, defects and markers.
NL, QUOTE, SLASH = "chr(10)", "chr(34)", "chr(92)"


def _each_line(before: str, after: str, text: str = "esc") -> str:
    """SQL: every line of ``text`` between two literals."""
    return f"concat('{before}', replace({text}, {NL}, concat('{after}', {NL}, '{before}')), '{after}')"


_QUOTED = f"{SLASH}, {QUOTE}, 'q', {SLASH}, {QUOTE}, ' '"  # an escaped "q" at the start of a literal
_PY_FORMS = f"""CASE row_id % 4 WHEN 0 THEN {_each_line('    # ', '', 'payload')}
    WHEN 1 THEN concat('    t = [', {NL}, {_each_line('        "', '",')}, {NL}, '    ]')
    WHEN 2 THEN concat('    use("', {_QUOTED}, replace(esc, {NL}, concat('")', {NL}, '    use("', {_QUOTED})), '")')
    ELSE {_each_line('    if(len("', '") > a): c = b')} END"""
_C_FORMS = f"""CASE row_id % 4 WHEN 0 THEN {_each_line('    // ', '', 'payload')}
    WHEN 1 THEN concat('    String[] t = {{{{', {NL}, {_each_line('        "', '",')}, {NL}, '    }}}};')
    WHEN 2 THEN concat('    use("', {_QUOTED}, replace(esc, {NL}, concat('");', {NL}, '    use("', {_QUOTED})), '");')
    ELSE {_each_line('    if (len("', '") > a) {{{{ c = b; }}}}')} END"""
_PY_FORMS, _C_FORMS = (x.replace("{{{{", "{{").replace("}}}}", "}}") for x in (_PY_FORMS, _C_FORMS))
_TWICE = "CASE WHEN row_id % 7 = 0 THEN concat('{line}', chr(10)) ELSE '' END"
_OFTEN = "repeat(concat('{line}', chr(10)), CASE WHEN row_id % 31 = 0 THEN 80 WHEN row_id % 25 = 0 THEN 7 ELSE 0 END)"

CODE_BASE_SQL = f"""
SELECT row_id, language, func_name, documentation, function_def, prompt, code_completion, payload,
  CASE WHEN row_id % 19 = 0 THEN ''
       WHEN row_id % 17 = 0 THEN concat(chr(10), '    pass')
       ELSE concat(CASE WHEN row_id % 6 = 1 THEN '<｜begin▁of▁sentence｜>' ELSE '' END, prompt, chr(10), body, chr(10), 'print(', row_id, ')',
         CASE WHEN row_id % 6 = 4 THEN '<｜end▁of▁sentence｜>' ELSE '' END) END AS prediction
FROM (
  SELECT *, CASE row_id % 20 WHEN 0 THEN replace(code_completion, 'a + b', 'a + (b') WHEN 15 THEN replace(code_completion, 'a + b', 'a + (b')
      WHEN 5 THEN replace(code_completion, 'return c', 'return c)') WHEN 10 THEN replace(code_completion, 'c = a', 'c = = a')
      ELSE code_completion END AS body,
    CASE WHEN language = 'python' THEN concat(function_def, chr(10), '    # ', replace(documentation, chr(10), concat(chr(10), '    # ')))
         ELSE concat('/** ', documentation, ' */', chr(10), function_def) END AS prompt
  FROM (
    SELECT row_id, language, payload, concat(CASE row_id % 4 WHEN 2 THEN 'Mod.Cls.' WHEN 3 THEN 'pkg.' ELSE '' END, name) AS func_name,
      concat('Doc: ', CASE WHEN row_id % 10 = 0 THEN all_lines ELSE first_line END,
        CASE WHEN language = 'python' THEN CASE row_id % 4 WHEN 0 THEN ' :param a: x' WHEN 1 THEN ' Returns nothing.' WHEN 2 THEN ' Returns a sum. Args: a' ELSE '' END
             WHEN language = 'java' AND row_id % 4 > 0 THEN ' @param a x @return y' ELSE '' END,
        CASE WHEN row_id % 5 = 2 THEN ' // see also' ELSE '' END,
        CASE row_id % 11 WHEN 0 THEN ' TODO later' WHEN 3 THEN ' FixMe soon' WHEN 5 THEN ' tbd' ELSE '' END,
        CASE WHEN row_id % 13 = 0 THEN concat(' see ', lower(name)) ELSE '' END, ' End.') AS documentation,
      CASE language WHEN 'python' THEN concat('def ', name, '(', CASE WHEN row_id % 8 = 5 THEN 'a, b, p1, p2, p3, p4, p5, p6, p7, p8' WHEN row_id % 16 = 7 THEN 'a' ELSE 'a, b' END, '):')
        WHEN 'java' THEN concat('public int ', name, '(', CASE WHEN row_id % 8 = 5 THEN 'int a, int b, int p1, int p2, int p3, int p4, int p5, int p6, int p7, int p8' WHEN row_id % 16 = 7 THEN 'int a' ELSE 'int a, int b' END, ') {{{{')
        ELSE concat('fun ', name, '(', CASE WHEN row_id % 8 = 5 THEN 'a: Int, b: Int, p1: Int, p2: Int, p3: Int, p4: Int, p5: Int, p6: Int, p7: Int, p8: Int' WHEN row_id % 16 = 7 THEN 'a: Int' ELSE 'a: Int, b: Int' END, '): Int {{{{') END AS function_def,
      CASE language
        WHEN 'python' THEN concat('    c = a + ', CASE WHEN row_id % 33 = 0 THEN '(b' ELSE 'b' END, chr(10), {_TWICE.format(line='    c = a + b')}, {_OFTEN.format(line='    if(a): pass')},
          CASE WHEN row_id % 6 = 0 THEN concat('    def inner(x):', chr(10), '        \"\"\"Inner doc.\"\"\"', chr(10), '        return x', chr(10)) ELSE '' END,
          CASE WHEN row_id % 9 = 3 THEN concat('    # \"\"\"\" x', chr(10)) ELSE '' END, {_PY_FORMS}, chr(10), '    return c')
        WHEN 'java' THEN concat('    int c = a + b;', chr(10), {_TWICE.format(line='    int c = a + b;')}, {_OFTEN.format(line='    if(a > 0) {{{{ c++; }}}}')},
          {_C_FORMS}, chr(10), '    return c;', CASE WHEN row_id % 28 = 1 THEN '' ELSE concat(chr(10), '}}}}') END)
        ELSE concat('    val c = a + b', chr(10), {_TWICE.format(line='    val c = a + b')}, {_OFTEN.format(line='    if(a > 0) {{{{ println(c) }}}}')},
          {_C_FORMS}, chr(10), '    return c', CASE WHEN row_id % 28 = 2 THEN '' ELSE concat(chr(10), '}}}}') END) END AS code_completion
    FROM (
      SELECT *, replace(payload, chr(34), concat(chr(92), chr(34))) AS esc,
        CASE row_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'java' ELSE 'kotlin' END AS language,
        concat(CASE WHEN row_id % 2 = 0 THEN 'fn_' ELSE 'doIt_' END, row_id) AS name
      FROM (
        SELECT row_id, translate(split_part(plain, chr(10), 1), chr(34), chr(96)) AS first_line, translate(plain, chr(34), chr(96)) AS all_lines,
          substr(plain, length(split_part(plain, chr(10), 1)) + 2) AS payload
        FROM (
          SELECT doc_id AS row_id, translate(coalesce(text, ''), concat(chr(39), chr(92), chr(9), chr(11), chr(12), chr(13), chr(28), chr(29), chr(30), chr(133)), '`/        ') AS plain
          FROM {{documents}}) a) b) c) d) e
""".replace("{{{{", "{{").replace("}}}}", "}}")

CODE_SEED_SQL = """
SELECT row_id, language, func_name, documentation, function_def, prompt, code_completion
FROM {code_base}
"""

CODE_RAW_SQL = """
SELECT row_id, language, func_name, documentation AS func_documentation_string,
  CASE WHEN language = 'python' AND row_id % 23 <> 0
         THEN concat(function_def, chr(10), '    \"\"\"', documentation, '\"\"\"', chr(10), code_completion)
       WHEN language = 'java' AND row_id % 29 = 0 THEN replace(function_def, ' {{', ';')
       ELSE concat(function_def, chr(10), code_completion) END AS func_code_string,
  CASE WHEN language <> 'kotlin' THEN NULL WHEN row_id % 23 = 0 THEN function_def ELSE prompt END AS problem,
  CASE WHEN language = 'kotlin' THEN code_completion END AS solution
FROM {code_base}
"""

# Each user turn and the assistant's next one, joined by both keys: a window per
# conversation would put a long one into one task.
CONV_PAIRS_SQL = """
SELECT a.conv_id, a.turn, a.text AS prompt, b.text AS completion
FROM {conversations} a JOIN {conversations} b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
WHERE a.role = 'user' AND b.role = 'assistant'
"""

# Traces of the defects that CODE_BASE_SQL plants, in any code column.
BROKEN_SQL = "(contains({0}, 'a + (b') OR contains({0}, 'return c)') OR contains({0}, 'c = = a'))"

# A test run's outcome per prediction: broken code and empty output fail, and
# so does code with calls whose text is long (its tests time out, say).
RESULTS_SQL = f"""
SELECT row_id % 49 AS task_id, row_id AS sample_id,
  prediction <> '' AND NOT {BROKEN_SQL.format('prediction')} AND NOT (contains(prediction, 'use(') AND length(payload) > 1500)
    AND row_id % 49 <> 0 AS passed
FROM {{code_base}}
"""

# view name -> (template, inputs it reads)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "code_base": (CODE_BASE_SQL, ("documents",)),
    "code_seed": (CODE_SEED_SQL, ("code_base",)),
    "code_raw": (CODE_RAW_SQL, ("code_base",)),
    "conv_pairs": (CONV_PAIRS_SQL, ("conversations",)),
    "results": (RESULTS_SQL, ("code_base",)),
}


# Views of plain columns of another view: read from its files, never written again.
COLUMNS_ONLY = ("code_seed",)
# A view's part is derived from so many bytes of its source's files, in so many parts at most.
PART_BYTES, MAX_PARTS = 64 << 20, 10_000

_WRITTEN: dict[tuple, str] = {}


def _stamp(sf_dir: str, name: str) -> tuple:
    """Identity of a view's source files (size, mtime), so a changed table is
    re-derived; remote paths without local stat use the path alone."""
    stamps = []
    todo = [name]
    while todo:
        n = todo.pop()
        if n in VIEWS:
            todo.extend(VIEWS[n][1])
            continue
        try:
            st = os.stat(f"{sf_dir.rstrip('/')}/{n}.parquet")
            stamps.append((n, st.st_size, st.st_mtime_ns))
        except OSError:
            stamps.append((n,))
    return tuple(sorted(stamps))


def _parts(source: DataFrame) -> int:
    """Parts of about ``PART_BYTES`` of a table's files, two for each core at least: the
    test tables are one row group each, which one task would read and write."""
    n_bytes = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2 * source.sparkSession.sparkContext.defaultParallelism, min(MAX_PARTS, -(-n_bytes // PART_BYTES)))


def deal_out(rows: DataFrame) -> DataFrame:
    """A table's rows in even parts. They go by their place in the scan, so no key and no
    copies make a part larger, and nothing is sorted on the way, as rows dealt out in
    turn are."""
    return rows.withColumn("_at", F.monotonically_increasing_id()).repartition(_parts(rows), "_at").drop("_at")


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a lazy plan over the driver tables (inputs materialized)."""
    template, inputs = VIEWS[name]
    args = {}
    for inp in inputs:
        args[inp] = view(spark, sf_dir, inp) if inp in VIEWS else read_table(spark, sf_dir, inp)
    if name == "code_base":  # the source's text, not the several copies that the view makes of it
        args["documents"] = deal_out(args["documents"].select("doc_id", "text"))
    return spark.sql(template, **args)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a table: derived once per session and source version,
    written as parquet to the shared checkpoint folder and read back.

    Queries then scan physical columns (column pruning, pushed filters) as
    they would on a real seed or base table; a plain view would have its
    string expressions substituted into every filter that reads them. A view of
    another view's columns is a projection of its files."""
    from codepref.session import checkpoint_dir

    if name in COLUMNS_ONLY:
        return derive(spark, sf_dir, name)
    app = spark.conf.get("spark.app.id", None) or spark.conf.get("spark.app.name", "")
    key = (app, os.path.abspath(sf_dir), name, _stamp(sf_dir, name))
    path = _WRITTEN.get(key)
    if path is not None:
        try:
            return spark.read.parquet(path)
        except Exception:  # noqa: BLE001 - the folder was cleaned up: derive it again
            _WRITTEN.pop(key, None)
    path = f"{checkpoint_dir(spark).rstrip('/')}/views/{name}-{uuid.uuid4().hex}"
    rows = derive(spark, sf_dir, name)
    if name == "conv_pairs":  # a broadcast join leaves them in the parts of the scan
        rows = rows.repartition(_parts(read_table(spark, sf_dir, "conversations")))
    rows.write.option("compression", "zstd").parquet(path)
    _WRITTEN[key] = path
    return spark.read.parquet(path)


def oracle_ctes(*names: str) -> str:
    """``WITH`` clause defining the named views (and what they need) for DuckDB."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order or n not in VIEWS:
            return
        for dep in VIEWS[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    parts = []
    for n in order:
        template, inputs = VIEWS[n]
        parts.append(f"{n} AS ({template.format(**{i: i for i in inputs})})")
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
