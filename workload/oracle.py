"""DuckDB twins of the registered queries.

They are written from the member rows with SQL's own means (sorted lists, windows, set operators)
rather than as a copy of the Spark plans, so that agreement means something.
"""

from tallyloom.functions.uniform import BITS, stream

CODES = range(1, 10)

MEMBERS = """members AS (
  SELECT l_orderkey AS hid,
         CAST(1 + floor((l_quantity - 1) / 6) AS INTEGER) AS age,
         CAST(1 + floor((l_quantity - 1) / 3) AS INTEGER) AS age5,
         l_returnflag AS flag
  FROM lineitem)"""


def matrix(name: str = "matrix", where: str = "", codes=CODES) -> str:
    cells = ", ".join(f"count(*) FILTER (age = {a}) AS b{a}" for a in codes)
    cells += f", count(*) FILTER (age IS NULL OR age NOT BETWEEN {codes[0]} AND {codes[-1]}) AS b_other"
    return f"{name} AS (SELECT hid, count(*) AS hh_size, {cells} FROM members {where} GROUP BY hid)"


DWELLINGS = """dwellings AS (
  SELECT o_orderkey AS hid, CAST(left(o_orderpriority, 1) AS INTEGER) AS hh_type,
         o_orderstatus AS head_age, o_custkey AS custkey, o_totalprice AS worth
  FROM orders)"""

SIZED = """sized AS (
  SELECT h.*, s.hh_size, s.child, s.elder
  FROM dwellings h {how} JOIN (
    SELECT hid, CAST(least(count(*), 6) AS INTEGER) AS hh_size,
           CAST(least(count(*) FILTER (age = 1), 3) AS INTEGER) AS child,
           CAST(least(count(*) FILTER (age >= 7), 3) AS INTEGER) AS elder
    FROM members GROUP BY hid) s USING (hid))"""

TYPED = """typed AS (
  SELECT g.hh_size, g.head_age, CAST(t.hh_type AS INTEGER) AS hh_type, count(s.hid) AS n
  FROM (SELECT DISTINCT hh_size, head_age FROM sized) g
  CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS hh_type) t
  LEFT JOIN sized s ON s.hh_size = g.hh_size AND s.head_age = g.head_age AND s.hh_type = t.hh_type
  GROUP BY ALL)"""

PATTERNS = """cells AS (
  SELECT {by} hid, age, count(*) AS k FROM members GROUP BY ALL),
entities AS (
  SELECT {by} hid, CAST(sum(k) AS BIGINT) AS hh_size,
         string_agg(age || '{{' || k || '}}', '+' ORDER BY age) AS pattern,
         flatten(list(list_value(age, -k) ORDER BY age)) AS sorted
  FROM cells GROUP BY ALL),
counted AS (
  SELECT {by} hh_size, pattern, any_value(sorted) AS sorted, count(*) AS n
  FROM entities GROUP BY {by} hh_size, pattern),
shared AS (
  SELECT *, n / sum(n) OVER (PARTITION BY {by} hh_size) AS share FROM counted)"""

PURCHASES = """SELECT ts, event_id, user_id,
  CASE WHEN event_type = 'purchase' THEN value END AS v FROM events"""


# The primes of xxHash64, and the seed the hash starts from.
P1, P2, P3, P4, P5 = (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
)
HASH_SEED = 42
MASK = f"{2**64 - 1}::UHUGEINT"


def let(value: str, name: str, body: str) -> str:
    """Name a value so that it is computed once."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def times(value: str, prime: int) -> str:
    return f"((({value}) * {prime}::UHUGEINT) & {MASK})"


def rotated(name: str, bits: int) -> str:
    return f"((({name} * {2**bits}::UHUGEINT) & {MASK}) + ({name} >> {64 - bits}))"


def folded(name: str, bits: int) -> str:
    return f"xor({name}, {name} >> {bits})"


def hashed(keys: list[str]) -> str:
    """xxHash64 of whole numbers that are not negative, each one seeded by the hash before it."""
    state = f"{HASH_SEED}::UHUGEINT"
    for key in keys:
        lane = let(times(f"({key})::UHUGEINT", P2), "a", times(rotated("a", 31), P1))
        state = f"xor(({state} + {(P5 + 8) % 2**64}::UHUGEINT) & {MASK}, {lane})"
        state = let(state, "b", f"({times(rotated('b', 27), P1)} + {P4}::UHUGEINT) & {MASK}")
        state = let(state, "c", times(folded("c", 33), P2))
        state = let(state, "d", times(folded("d", 29), P3))
        state = let(state, "e", folded("e", 32))
    return state


def uniform(keys: str, salt: str, seed: int = 1) -> str:
    text = hashed([*keys.split(", "), str(stream(salt, seed))])
    return f"(({text} >> {64 - BITS})::BIGINT / {float(2**BITS)!r}::DOUBLE)"


def normal(key: str, mean: float, sd: float, salt: str, seed: int = 1) -> str:
    radius = f"sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {uniform(key, salt + '.r', seed)}))"
    angle = f"(2.0::DOUBLE * pi() * {uniform(key, salt + '.a', seed)})"
    return f"({mean}::DOUBLE + {sd}::DOUBLE * {radius} * cos({angle}))"


def drawn(rows: str, dist: str, keys: tuple[str, ...], outcome: str, number: str) -> str:
    """Text of a weighted draw: dist has keys, outcome, n."""
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    match = "".join(f"r.{k} = d.{k} AND " for k in keys)
    chosen = ", ".join(["r.hid", *[f"r.{k}" for k in keys], f"d.{outcome}"])
    return f"""intervals AS (
  SELECT *, sum(n) OVER ({part} ORDER BY {outcome}) - n AS lo,
         sum(n) OVER ({part} ORDER BY {outcome}) AS hi, sum(n) OVER ({part}) AS total
  FROM {dist} WHERE n > 0),
numbered AS (SELECT *, {number} AS u FROM {rows})
SELECT {chosen} FROM numbered r LEFT JOIN intervals d
  ON {match} r.u * d.total >= d.lo AND r.u * d.total < d.hi"""


def pick(weights: dict[int, int], number: str) -> str:
    whole, upto, text = sum(weights.values()), 0, ""
    *head, last = weights
    for outcome in head:
        upto += weights[outcome]
        text += f" WHEN {number} * {whole} < {upto} THEN {outcome}"
    return f"CASE{text} ELSE {last} END"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def distance(target: str, counts: list[str]) -> str:
    whole = "(" + " + ".join(counts) + ")"
    squares = " + ".join(
        f"({target}{i} - {c} / {whole}) * ({target}{i} - {c} / {whole})"
        for i, c in zip(CODES, counts, strict=True)
    )
    return f"CASE WHEN {whole} = 0 THEN 100.0::DOUBLE ELSE {squares} END"


TARGET = (
    "target AS (SELECT "
    + ", ".join(f"count(*) FILTER (age = {a}) / count(*) AS p{a}" for a in CODES)
    + " FROM members)"
)


BANDS = ", ".join(f"b{a}" for a in CODES)
OTHER = "b_other"
MEMBER_SHARES = """{name}_dist AS (
  SELECT hh_type, hh_size, {name}, count(*) / sum(count(*)) OVER (PARTITION BY hh_type, hh_size) AS p
  FROM sized GROUP BY hh_type, hh_size, {name})"""
TYPE_SHARES = """type_dist AS (
  SELECT *, CASE WHEN n > 0 THEN n / sum(n) OVER (PARTITION BY head_age, hh_size) ELSE 0.0::DOUBLE END AS p
  FROM typed)"""


def paired(category: str, population: str, sample: str, by: str = "") -> str:
    keys = f"{by}{category}"
    part = f"PARTITION BY {by.rstrip(', ')}" if by else ""
    return f"""counts AS (
  SELECT {keys}, CAST(sum(pop) AS BIGINT) AS n_pop, CAST(sum(smp) AS BIGINT) AS n_sample
  FROM (SELECT {keys}, n AS pop, 0 AS smp FROM ({population})
        UNION ALL SELECT {keys}, 0, n FROM ({sample})) GROUP BY ALL),
report AS (
  SELECT *, n_pop / nullif(sum(n_pop) OVER ({part}), 0) AS pp,
         n_sample / nullif(sum(n_sample) OVER ({part}), 0) AS ps FROM counts)"""


def report_rows(keys: str, digits: int) -> str:
    return f"""SELECT {keys}, n_pop, n_sample, round(pp, 6) AS p_pop, round(ps, 6) AS p_sample,
  round(ps - pp, {digits}) AS diff FROM report"""


def size_pair() -> str:
    counts = "SELECT hh_size, count(*) AS n FROM {} GROUP BY hh_size"
    return paired("hh_size", counts.format("matrix"), counts.format("sample"))


def band_pair() -> str:
    counts = "SELECT c.age, count(m.hid) AS n FROM codes c LEFT JOIN members m ON m.age = c.age {} GROUP BY c.age"
    return paired("age", counts.format(""), counts.format("AND m.flag = 'R'"))


def type_pair() -> str:
    counts = "SELECT hh_type, count(*) AS n FROM dwellings JOIN {} USING (hid) GROUP BY hh_type"
    return paired("hh_type", counts.format("matrix"), counts.format("sample"))


def band_size_pair() -> str:
    counts = (
        "SELECT hh_size, c.age, count(x.hid) AS n FROM (SELECT DISTINCT hh_size FROM {0}) s CROSS JOIN codes c"
        " LEFT JOIN (SELECT m.hid, m.age, s.hh_size FROM members m JOIN {0} s USING (hid) {1}) x"
        " USING (hh_size, age) GROUP BY hh_size, c.age"
    )
    return paired(
        "age", counts.format("matrix", ""), counts.format("sample", "WHERE m.flag = 'R'"), by="hh_size, "
    )


CODE_TABLE = "codes AS (SELECT CAST(unnest(range(1, 10)) AS INTEGER) AS age)"
SAMPLE = matrix("sample", "WHERE flag = 'R'")
PAIR_TABLES = (MEMBERS, matrix(), SAMPLE, DWELLINGS, CODE_TABLE)
BASE = with_(MEMBERS, matrix()) + "\n"
QUANTITIES = """WITH quantities AS (
  SELECT l_orderkey AS hid, CASE WHEN l_quantity % 17 <> 0 THEN CAST(l_quantity AS INTEGER) END AS code FROM lineitem),
entities AS (
  SELECT hid, CAST(sum(k) AS BIGINT) AS hh_size,
         string_agg(coalesce(CAST(code AS VARCHAR), '?') || '{' || k || '}', '+' ORDER BY code NULLS LAST) AS pattern
  FROM (SELECT hid, code, count(*) AS k FROM quantities GROUP BY ALL) GROUP BY hid)"""
LABELS = """WITH labels_ AS (
  SELECT o_orderkey AS hid, CASE WHEN o_custkey % 17 = 0 THEN 'Unlisted ' || (o_custkey % 5)
         ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS label FROM orders)"""
SIZED_BASE = (MEMBERS, DWELLINGS, SIZED.format(how=""))

STRATIFIED = (
    with_(MEMBERS, matrix(), DWELLINGS, TARGET)
    + """,
placed AS (
  SELECT c.c_mktsegment AS stratum, m.*
  FROM matrix m JOIN dwellings h USING (hid) JOIN customer c ON c.c_custkey = h.custkey),
running AS (SELECT stratum, hid, """
    + ", ".join(f"CAST(sum(b{a}) OVER w AS BIGINT) AS r{a}" for a in CODES)
    + " FROM placed WINDOW w AS (PARTITION BY stratum ORDER BY hid ROWS UNBOUNDED PRECEDING)),\nscored AS (SELECT stratum, hid, "
    + " + ".join(f"r{a}" for a in CODES)
    + " AS n_so_far, "
    + distance("p", [f"r{a}" for a in CODES])
    + """ AS ss FROM running CROSS JOIN target),
stepped AS (
  SELECT *, ss - lag(ss, 1, 100.0::DOUBLE) OVER (PARTITION BY stratum ORDER BY hid) AS change FROM scored)
"""
)
HEADS = """heads AS (
  SELECT h.hid, h.hh_type, CAST(least(m.hh_size, 6) AS INTEGER) AS hh_size,
    ['0 - 24', '25 - 29', '30 - 34', '35 - 39', '40 - 44', '45 - 49', '50 - 54', '55 - 59', '60 - 64', '65+'][custkey % 10 + 1]
    AS head_age
  FROM dwellings h JOIN matrix m USING (hid))"""

ORACLE: dict[str, str] = {
    "patterns_by_size": with_(MEMBERS, PATTERNS.format(by=""))
    + "\nSELECT hh_size, pattern, n, round(share, 6) AS p FROM shared",
    "top_patterns": with_(MEMBERS, PATTERNS.format(by=""))
    + """
SELECT * FROM (
  SELECT hh_size, pattern, n, round(share, 6) AS p,
         CAST(row_number() OVER (PARTITION BY hh_size ORDER BY n DESC, sorted) AS INTEGER) AS rank
  FROM shared) WHERE rank <= 3""",
    "most_frequent_patterns": with_(MEMBERS, PATTERNS.format(by=""))
    + "\nSELECT hh_size, pattern, n, round(share, 6) AS p FROM shared ORDER BY n DESC, sorted LIMIT 20",
    "patterns_two_populations": with_(MEMBERS, PATTERNS.format(by="flag,"))
    + "\nSELECT flag AS population, hh_size, pattern, n, round(share, 6) AS p FROM shared",
    "patterns_stored_size": with_(
        MEMBERS, PATTERNS.format(by="").replace("CAST(sum(k) AS BIGINT) AS hh_size", "hid % 6 + 1 AS hh_size")
    )
    + "\nSELECT hh_size, pattern, n, round(share, 6) AS p FROM shared",
    "populations_stacked": with_(
        MEMBERS.replace("members AS", "once AS"),
        "members AS (SELECT 'all' AS flag, hid, age FROM once UNION ALL SELECT 'sample', hid, age FROM once WHERE flag = 'R')",
        PATTERNS.format(by="flag,"),
    )
    + "\nSELECT flag AS population, hh_size, pattern, n, round(share, 6) AS p FROM shared",
    "patterns_wide": f"""SELECT w.*, {BANDS}, {OTHER}, CAST(0 AS BIGINT) AS n_over
FROM (PIVOT (
  SELECT l_orderkey AS hid, CAST(1 + floor((l_quantity - 1) / 6) AS INTEGER) AS age,
         count(*) OVER (PARTITION BY l_orderkey) AS hh_size,
         'age_' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS place FROM lineitem)
  ON place USING max(age) GROUP BY hid, hh_size) w
JOIN (SELECT * EXCLUDE (hh_size) FROM ({with_(MEMBERS, matrix())} SELECT * FROM matrix)) m USING (hid)""",
    "patterns_any_code": QUANTITIES
    + """, counted AS (SELECT hh_size, pattern, count(*) AS n FROM entities GROUP BY ALL)
SELECT hh_size, pattern, n, round(n / sum(n) OVER (PARTITION BY hh_size), 6) AS p FROM counted""",
    "members_array": QUANTITIES
    + """
SELECT hid, hh_size, pattern AS runs, a[1] AS first, a[(hh_size + 1) // 2] AS middle, a[hh_size] AS last, a[10] AS tenth
FROM entities JOIN (SELECT hid, list(code ORDER BY code NULLS LAST) AS a FROM quantities GROUP BY hid) USING (hid)""",
    "size_distribution": BASE
    + "SELECT hh_size, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS p FROM matrix GROUP BY hh_size",
    "stored_size_distribution": BASE
    + """SELECT CAST(least(hh_size, 6) AS INTEGER) AS hh_size, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (), 6) AS p FROM matrix GROUP BY ALL""",
    "sizes_zero_filled": BASE
    + """SELECT CAST(d.s AS INTEGER) AS hh_size, count(m.hid) AS n
FROM (SELECT unnest(range(1, (SELECT max(hh_size) + 1 FROM matrix))) AS s) d
LEFT JOIN matrix m ON m.hh_size = d.s GROUP BY d.s""",
    "worth_gaps": with_(DWELLINGS)
    + """, hundreds AS (SELECT hh_type, CAST(floor(worth / 100) AS BIGINT) AS hundreds FROM dwellings)
SELECT d.hh_type, d.hundreds, count(h.hh_type) AS n
FROM (SELECT hh_type, unnest(range(least(1, min(hundreds)), max(hundreds) + 1)) AS hundreds FROM hundreds GROUP BY hh_type) d
LEFT JOIN hundreds h ON h.hh_type = d.hh_type AND h.hundreds = d.hundreds GROUP BY d.hh_type, d.hundreds
HAVING d.hundreds > 0 OR count(h.hh_type) > 0""",
    "size_by_band1_margins": BASE
    + "SELECT coalesce(CAST(hh_size AS VARCHAR), 'Sum') AS hh_size, "
    + ", ".join(f"count(*) FILTER (b1 = {k}) AS c{k}" for k in range(7))
    + ", count(*) FILTER (b1 > 6) AS c_other, count(*) AS total FROM matrix GROUP BY ROLLUP (hh_size)",
    "single_member_bands": with_(MEMBERS, matrix(), CODE_TABLE)
    + """
SELECT age, n, round(n / sum(n) OVER (), 6) AS p FROM (
  SELECT c.age, count(s.hid) AS n FROM codes c
  LEFT JOIN (SELECT m.hid, m.age FROM members m JOIN matrix x USING (hid) WHERE x.hh_size = 1) s
  USING (age) GROUP BY c.age)""",
    "single_member_stored": with_(MEMBERS, CODE_TABLE)
    + """
SELECT age, n, round(n / sum(n) OVER (), 6) AS p FROM (
  SELECT c.age, count(m.hid) AS n FROM codes c
  LEFT JOIN members m ON m.age = c.age AND m.hid % 6 + 1 = 1 GROUP BY c.age)""",
    "roster_matrix": BASE + f"SELECT hid, {BANDS}, {OTHER} FROM matrix",
    "long_from_names": with_(MEMBERS) + "\nSELECT hid, age, count(*) AS value FROM members GROUP BY hid, age",
    "roster_block": "SELECT l_returnflag AS flag, count(*) AS n_rows FROM lineitem GROUP BY l_returnflag",
    "roster_long": with_(MEMBERS) + "\nSELECT hid, age, count(*) AS value FROM members GROUP BY hid, age",
    "roster_rebuilt": BASE + f"SELECT hid, {BANDS}, {OTHER} FROM matrix",
    "roster_persons": with_(MEMBERS)
    + "\nSELECT hid, row_number() OVER (PARTITION BY hid ORDER BY age) AS pid, age FROM members",
    "roster_sizes": BASE + f"SELECT hid, b1, {OTHER}, hh_size FROM matrix",
    "couples_of_two": with_(*SIZED_BASE)
    + "\nSELECT hid, hh_type, hh_size FROM sized WHERE hh_size = 2 AND hh_type IN (1, 2, 4, 5)",
    "first_rosters": BASE + f"SELECT hid, {BANDS}, {OTHER} FROM matrix ORDER BY hid LIMIT 6",
    "margin_type_given_head_size": with_(*SIZED_BASE, TYPED, TYPE_SHARES)
    + "\nSELECT hh_size, head_age, hh_type, n, round(p, 6) AS p FROM type_dist",
    "margin_type_from_sheet": with_(*SIZED_BASE, TYPED, TYPE_SHARES)
    + "\nSELECT hh_size, head_age, hh_type, n, round(p, 6) AS p FROM type_dist",
    "margin_head_from_sheet": with_(MEMBERS, matrix(), DWELLINGS, HEADS)
    + """, cells AS (
  SELECT s.hh_size, l.head_age, l.head_code, count(h.hid) AS n
  FROM (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS hh_size) s
  CROSS JOIN (SELECT heads.head_age, CAST(custkey % 10 + 1 AS INTEGER) AS head_code
    FROM heads JOIN dwellings USING (hid) GROUP BY ALL) l
  LEFT JOIN heads h ON h.hh_size = s.hh_size AND h.head_age = l.head_age GROUP BY ALL)
SELECT *, round(n / nullif(sum(n) OVER (PARTITION BY hh_size), 0), 6) AS p FROM cells""",
    "margin_head_given_size": with_(*SIZED_BASE)
    + """
SELECT hh_size, head_age, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY hh_size), 6) AS p FROM sized GROUP BY hh_size, head_age""",
    "margin_type": with_(*SIZED_BASE)
    + """
SELECT hh_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS p FROM sized GROUP BY hh_type""",
    "margin_size": BASE
    + "SELECT hh_size, round(count(*) / sum(count(*)) OVER (), 6) AS p FROM matrix GROUP BY hh_size",
    "margin_band_pairs": with_(MEMBERS)
    + """
SELECT CAST((age5 + 1) // 2 AS INTEGER) AS age, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (), 6) AS p FROM members GROUP BY ALL""",
    "margin_band_by_size": with_(MEMBERS, matrix(), CODE_TABLE)
    + """
SELECT hh_size, age, n, round(n / sum(n) OVER (PARTITION BY hh_size), 6) AS p FROM (
  SELECT s.hh_size, c.age, count(x.hid) AS n
  FROM (SELECT DISTINCT hh_size FROM matrix) s CROSS JOIN codes c
  LEFT JOIN (SELECT m.hid, m.age, hh_size FROM members m JOIN matrix USING (hid)) x
    ON x.hh_size = s.hh_size AND x.age = c.age
  GROUP BY s.hh_size, c.age)""",
    "clean_cells": with_(DWELLINGS)
    + """
SELECT hid,
  regexp_replace(CASE WHEN hid % 5 = 0 THEN head_age ELSE 'Type (' || hh_type || ')' END,
                 '.+\\((\\d)\\)', '\\1') AS digit,
  CASE WHEN hid % 7 = 0 THEN 0 WHEN hid % 11 = 0 THEN NULL
       ELSE CAST(floor(worth) AS BIGINT) END AS n,
  CASE head_age WHEN 'F' THEN '1' WHEN 'O' THEN '2' END AS code,
  CASE head_age WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE head_age END AS code_or_label,
  CAST((hid % 18 + 2) // 2 AS INTEGER) AS age,
  (10 * ((hid % 18 + 2) // 2) - 10) || ' - ' || (10 * ((hid % 18 + 2) // 2) - 1) AS age_label
FROM dwellings""",
    "fill_down": f"""SELECT event_id, user_id,
  last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM ({PURCHASES})""",
    "fill_down_table": f"""SELECT event_id, user_id,
  last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM ({PURCHASES})""",
    "fill_down_by_name": """SELECT c_name, c_nationkey, c_custkey,
  last_value(CASE WHEN c_acctbal >= 0 THEN c_acctbal END IGNORE NULLS) OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_balance FROM customer""",
    "fill_down_ties": f"""SELECT event_id, last_value(v IGNORE NULLS) OVER (
  ORDER BY CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2020-01-01 12:00:00' WHEN event_id % 10 <> 1 THEN ts END NULLS FIRST, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM ({PURCHASES})""",
    "sheet_with_order": """SELECT ord, hid, head_age FROM (
  SELECT o_orderkey AS hid, o_orderstatus AS head_age, row_number() OVER (ORDER BY o_orderkey) AS ord FROM orders) WHERE ord > 18""",
    "recode_by_table": LABELS + " SELECT hid, label, c_nationkey AS code FROM labels_ LEFT JOIN customer ON c_name = label",
    "recode_unmatched": LABELS
    + " SELECT label, count(*) AS n FROM labels_ LEFT JOIN customer ON c_name = label WHERE c_name IS NULL GROUP BY label",
    "margins_cube": with_(MEMBERS, DWELLINGS, SIZED.format(how=""))
    + """, dims AS (SELECT DISTINCT hh_type FROM sized), heads AS (SELECT DISTINCT head_age FROM sized),
sizes AS (SELECT DISTINCT hh_size FROM sized),
grid AS (
  SELECT hh_type, head_age, hh_size, 0 AS n FROM dims CROSS JOIN heads CROSS JOIN sizes
  UNION ALL SELECT hh_type, head_age, hh_size, 1 FROM sized)
SELECT hh_type, head_age, hh_size, CAST(grouping(hh_type, head_age, hh_size) AS INTEGER) AS level, CAST(sum(n) AS BIGINT) AS n
FROM grid GROUP BY CUBE (hh_type, head_age, hh_size)""",
    "fit_two_tables": """WITH a AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1),
b AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1),
sides AS (
  SELECT nation, coalesce(a.n, 0) AS n_pop, coalesce(b.n, 0) AS n_sample,
         coalesce(a.n, 0) / sum(a.n) OVER () AS p, coalesce(b.n, 0) / sum(b.n) OVER () AS q
  FROM a FULL JOIN b USING (nation))
SELECT nation, CAST(n_pop AS BIGINT) AS n_pop, CAST(n_sample AS BIGINT) AS n_sample, round(p, 6) AS p_pop, round(q, 6) AS p_sample,
       round(q - p, 4) AS diff FROM sides""",
    "price_variance": """SELECT o_custkey AS custkey, count(*) AS n,
  round(CAST(count(*) * sum(x * x) - sum(x) * sum(x) AS DOUBLE) / nullif(count(*) * (count(*) - 1), 0) / 10000, 2) AS variance
FROM (SELECT o_custkey, CAST(round(o_totalprice * 100) AS HUGEINT) AS x FROM orders) GROUP BY o_custkey""",
    "member_numbers": """SELECT event_id, user_id,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pid FROM events""",
    "row_ids": """SELECT hid, row_id, CAST((row_id - 1) // 18 + 1 AS INTEGER) AS block,
  CAST((row_id - 1) // 10 % 8 + 1 AS INTEGER) AS block_of_8
FROM (SELECT o_orderkey AS hid, row_number() OVER (ORDER BY o_orderkey) AS row_id FROM orders)""",
    "fit_size": with_(*PAIR_TABLES, size_pair()) + "\n" + report_rows("hh_size", 4),
    "fit_band": with_(*PAIR_TABLES, band_pair()) + "\n" + report_rows("age", 3),
    "fit_type": with_(*PAIR_TABLES, type_pair()) + "\n" + report_rows("hh_type", 3),
    "fit_errors": "\nUNION ALL\n".join(
        f"SELECT * FROM ({with_(*PAIR_TABLES, pair)}\n"
        f"SELECT '{margin}' AS margin, round(sum((ps - pp) * (ps - pp)), 9) AS ss FROM report)"
        for margin, pair in (("hh_size", size_pair()), ("age", band_pair()), ("hh_type", type_pair()))
    ),
    "fit_band_by_size": with_(*PAIR_TABLES, band_size_pair()) + "\n" + report_rows("hh_size, age", 4),
    "fit_band_by_size_errors": with_(*PAIR_TABLES, band_size_pair())
    + "\nSELECT hh_size, round(sum((ps - pp) * (ps - pp)), 9) AS ss FROM report GROUP BY hh_size",
    "shortfall": """SELECT o_orderkey AS hid, o_orderkey % 6 + 1 AS declared, coalesce(n, 0) AS n_members,
  o_orderkey % 6 + 1 - coalesce(n, 0) AS n_missing
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
  ON l_orderkey = o_orderkey""",
    "no_members": """SELECT o_orderkey AS hid FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "group_variance": with_(MEMBERS)
    + """
SELECT hid, n, round(v, 6) AS variance,
  CASE WHEN v IS NULL THEN 'single' WHEN v > 0.5 THEN 'apart' ELSE 'close' END AS kind,
  least(4, greatest(2, n)) AS n_clamped
FROM (SELECT hid, count(age) AS n,
    CAST(count(age) * sum(age * age) - sum(age) * sum(age) AS DOUBLE)
      / nullif(CAST(count(age) * (count(age) - 1) AS DOUBLE), 0) AS v FROM members GROUP BY hid)""",
    "draw_weighted": with_(
        MEMBERS, DWELLINGS, "dist AS (SELECT age, count(*) AS n FROM members GROUP BY age)"
    )
    + ",\n"
    + drawn("dwellings", "dist", (), "age", uniform("hid", "band")),
    "draw_conditional": with_(
        MEMBERS, DWELLINGS, SIZED.format(how="LEFT"), TYPED.replace("FROM sized)", "FROM sized WHERE hh_size > 0)")
    )
    + ",\nrows AS (SELECT hid, head_age, hh_size FROM sized),\n"
    + drawn("rows", "typed", ("hh_size", "head_age"), "hh_type", uniform("hid", "type")),
    "draw_fixed": f"""SELECT hid, {pick({7: 97, 8: 124, 9: 114}, "u")} AS age
FROM (SELECT o_orderkey AS hid, {uniform("o_orderkey", "elder")} AS u FROM orders)""",
    "draw_bernoulli": f"""SELECT o_orderkey AS hid,
  CAST({uniform("o_orderkey", "gap")} < 0.25::DOUBLE AS INTEGER) AS gap FROM orders""",
    "draw_normal": f"""SELECT o_orderkey AS hid,
  least(9, greatest(2, CAST(round({normal("o_orderkey", 3.0, 1.0, "birth")}) AS INTEGER))) AS age FROM orders""",
    "draw_repeat": f"""SELECT hid, count(*) FILTER (age = 7) AS b7, count(*) FILTER (age = 8) AS b8,
  count(*) FILTER (age = 9) AS b9, CAST(0 AS BIGINT) AS b_other
FROM (SELECT hid, {pick({7: 1, 8: 2, 9: 2}, "u")} AS age
      FROM (SELECT hid, {uniform("hid, copy", "elders")} AS u
            FROM (SELECT o_orderkey AS hid, unnest(range(1, o_orderkey % 4 + 1)) AS copy FROM orders))) GROUP BY hid""",
    "dist_joint": with_(*SIZED_BASE, MEMBER_SHARES.format(name="child"), MEMBER_SHARES.format(name="elder"))
    + """,
pairs AS (
  SELECT hh_type, hh_size, child, elder, c.p * e.p AS pp
  FROM child_dist c JOIN elder_dist e USING (hh_type, hh_size) WHERE child + elder < hh_size)
SELECT hh_type, hh_size, child, elder,
  round(pp / sum(pp) OVER (PARTITION BY hh_type, hh_size), 6) AS p FROM pairs""",
    "dist_joint_marginals": with_(*SIZED_BASE, MEMBER_SHARES.format(name="child"), MEMBER_SHARES.format(name="elder"))
    + """,
pairs AS (
  SELECT hh_type, hh_size, child, sum(c.p * e.p) AS pp
  FROM child_dist c JOIN elder_dist e USING (hh_type, hh_size) WHERE child + elder < hh_size GROUP BY ALL)
SELECT hh_type, hh_size, child, round(pp / sum(pp) OVER (PARTITION BY hh_type, hh_size), 6) AS p FROM pairs""",
    "dist_exclude": with_(*SIZED_BASE, TYPED, TYPE_SHARES)
    + """
SELECT hh_size, head_age, hh_type, round(p / sum(p) OVER (PARTITION BY hh_size, head_age), 6) AS p
FROM type_dist WHERE NOT (head_age = 'P' AND hh_type IN (4, 5))""",
    "dist_rebin": with_(MEMBERS)
    + """
SELECT CAST((age5 + 1) // 2 AS INTEGER) AS age, round(count(*) / (SELECT count(*) FROM members), 6) AS p
FROM members GROUP BY ALL""",
    "dist_rebin_by_type_size": with_(MEMBERS, matrix(), DWELLINGS, HEADS)
    + """, coarse AS (
  SELECT hh_type, hh_size,
    CASE WHEN head_age IN ('0 - 24', '25 - 29') THEN 3 WHEN head_age IN ('30 - 34', '35 - 39') THEN 4
         WHEN head_age IN ('40 - 44', '45 - 49') THEN 5 WHEN head_age IN ('50 - 54', '55 - 59') THEN 6
         WHEN head_age = '60 - 64' THEN 7 ELSE 8 END AS age,
    count(*) / sum(count(*)) OVER (PARTITION BY hh_type, hh_size) AS p
  FROM heads GROUP BY hh_type, hh_size, 3)
SELECT hh_type, hh_size, CAST(age AS INTEGER) AS age, round(p, 6) AS p FROM coarse WHERE age <> 8
UNION ALL
SELECT hh_type, hh_size, CAST(fine AS INTEGER), round(p * 0.5::DOUBLE, 6)
FROM coarse, (SELECT unnest([8, 9]) AS fine) WHERE age = 8""",
    "dist_split": with_(MEMBERS)
    + """,
coarse AS (
  SELECT CAST(least((age5 + 1) // 2, 8) AS INTEGER) AS age, count(*) / (SELECT count(*) FROM members) AS p
  FROM members GROUP BY ALL)
SELECT age, round(p, 6) AS p FROM coarse WHERE age <> 8
UNION ALL
SELECT CAST(fine AS INTEGER), round(p * 0.5::DOUBLE, 6)
FROM coarse, (SELECT unnest([8, 9]) AS fine) WHERE age = 8""",
    "recode_head": f"""SELECT hid, head_age,
  CASE WHEN head_age IN ('0 - 24', '25 - 29') THEN 3 WHEN head_age IN ('30 - 34', '35 - 39') THEN 4
       WHEN head_age IN ('40 - 44', '45 - 49') THEN 5 WHEN head_age IN ('50 - 54', '55 - 59') THEN 6
       WHEN head_age = '60 - 64' THEN 7
       ELSE {pick({7: 97, 8: 124, 9: 114}, "u")} END AS head_code
FROM (SELECT o_orderkey AS hid, {uniform("o_orderkey", "head")} AS u,
  ['0 - 24', '25 - 29', '30 - 34', '35 - 39', '40 - 44', '45 - 49', '50 - 54', '55 - 59', '60 - 64', '65+'][o_custkey % 10 + 1]
  AS head_age FROM orders)""",
    "derived_age": f"""SELECT hid, head, partner,
  greatest(1, partner - least(partner, greatest(2, CAST(round({normal("hid", 3.0, 1.0, "child")}) AS INTEGER)))) AS child,
  CASE WHEN head < 9 THEN least(9, greatest(4, head
    + least(5, greatest(1, CAST(round({normal("hid", 2.0, 1.0, "parent")}) AS INTEGER))))) END AS parent
FROM (SELECT hid, head, least(9, greatest(3, head - CAST({uniform("hid", "partner")} < 0.25::DOUBLE AS INTEGER))) AS partner
      FROM (SELECT o_orderkey AS hid, CAST(o_orderkey % 7 + 3 AS INTEGER) AS head FROM orders))""",
    "coverage": with_(MEMBERS)
    + """
SELECT flag, hh_size FROM (SELECT DISTINCT flag FROM members) CROSS JOIN (
  SELECT unnest(range(1, (SELECT max(n) + 1 FROM (SELECT count(*) AS n FROM members GROUP BY flag, hid)))) AS hh_size)
EXCEPT
SELECT flag, count(*) FROM members GROUP BY flag, hid""",
    "replicate_fit": with_(
        MEMBERS, matrix(), "dist AS (SELECT hh_size, count(*) AS n FROM matrix GROUP BY hh_size)"
    )
    + f""",
intervals AS (
  SELECT *, sum(n) OVER (ORDER BY hh_size) - n AS lo, sum(n) OVER (ORDER BY hh_size) AS hi,
         sum(n) OVER () AS total FROM dist),
numbered AS (
  SELECT o_orderkey AS hid, r AS replicate, {uniform("o_orderkey, r", "size")} AS u
  FROM orders CROSS JOIN (SELECT unnest(range(1, 9)) AS r)),
counted AS (
  SELECT replicate, hh_size, count(*) AS k
  FROM numbered JOIN intervals ON u * total >= lo AND u * total < hi GROUP BY ALL),
scored AS (
  SELECT r AS replicate, sum(pow(coalesce(k, 0) / (SELECT count(*) FROM orders) - n / total, 2)) AS ss
  FROM intervals CROSS JOIN (SELECT unnest(range(1, 9)) AS r)
  LEFT JOIN counted c ON c.replicate = r AND c.hh_size = intervals.hh_size GROUP BY r)
SELECT CAST(replicate AS INTEGER) AS replicate, round(ss, 9) AS ss, ss <= 0.00003 AS fits,
  coalesce(replicate = min(replicate) FILTER (ss <= 0.00003) OVER (), FALSE) AS chosen FROM scored""",
    "drift_monitor": with_(MEMBERS, matrix(), TARGET)
    + ",\nrunning AS (SELECT hid, "
    + ", ".join(f"CAST(sum(b{a}) OVER w AS BIGINT) AS r{a}" for a in CODES)
    + " FROM matrix WINDOW w AS (ORDER BY hid ROWS UNBOUNDED PRECEDING)),\nscored AS (SELECT hid, "
    + " + ".join(f"r{a}" for a in CODES)
    + " AS n_so_far, "
    + distance("p", [f"r{a}" for a in CODES])
    + """ AS ss FROM running CROSS JOIN target),
stepped AS (SELECT *, ss - lag(ss, 1, 100.0::DOUBLE) OVER (ORDER BY hid) AS change FROM scored)
SELECT hid, n_so_far, ss, change, change > 0 AS exceeds FROM stepped""",
    "drift_by_stratum": STRATIFIED + "SELECT stratum, hid, n_so_far, ss, change, change > 0 AS exceeds FROM stepped",
    "acceptance_by_stratum": STRATIFIED
    + """SELECT stratum, count(*) FILTER (change <= 0) AS accepted, count(*) FILTER (change > 0) AS rejected,
  round(avg(CAST(change <= 0 AS INTEGER)), 6) AS rate FROM stepped GROUP BY stratum""",
}

for _name, _share in (("child", "child"), ("elder", "elder")):
    ORACLE[f"margin_{_name}"] = (
        with_(*SIZED_BASE, MEMBER_SHARES.format(name=_share))
        + f"\nSELECT hh_type, hh_size, {_share}, round(p, 6) AS p FROM {_share}_dist"
    )
