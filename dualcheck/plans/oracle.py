"""DuckDB oracle SQL for the registered queries.

The truth is derived from the TPC-H source columns and the fixture's ``pmod``
rules (FIXTURES.md F-TPCH), as canonical values -- not by re-parsing the raw
responses -- and the flag / resolution / grounding / metric rules are then
applied in SQL. Spark has to parse "25 October 1997" and "USD 248,648.08"
back to the date and number DuckDB reads straight from the source.
"""
from __future__ import annotations

PRIOS = "['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW']"


def _cn(x: str) -> str:
    """String canonical form of TPC-H names ('Customer#000000001' -> 'customer 000000001')."""
    return f"lower(replace({x}, '#', ' '))"


def _set(x: str) -> str:
    return f"list_sort(list_distinct(list_transform({x}, lambda e: {_cn('e')})))"


def _num_text(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN '' WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) "
            f"ELSE CAST({x} AS VARCHAR) END")


def _arbk(i: int) -> str:
    return f"CASE WHEN (k + {i}) % 5 = 1 THEN 't' WHEN (k + {i}) % 7 = 2 THEN 'c' ELSE 'g' END"


BASE = rf"""
sp AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
sr AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS rn FROM sp),
s3 AS (SELECT sr.l_orderkey, list(s.s_name ORDER BY sr.rn) AS names
       FROM sr JOIN supplier s ON s.s_suppkey = sr.l_suppkey GROUP BY sr.l_orderkey),
b0 AS (
  SELECT o.o_orderkey AS k, o.o_totalprice AS tp, CAST(o.o_orderdate AS DATE) AS od, o.o_orderpriority AS pr,
         c.c_name, n.n_name, coalesce(s3.names, []::VARCHAR[]) AS names
  FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN s3 ON s3.l_orderkey = o.o_orderkey),
b1 AS (
  SELECT *, CASE WHEN k % 10 < 7 THEN n_name ELSE '' END AS g_nation,
         (k % 10 >= 7 AND k % 3 = 0) AS fab, k % 97 = 0 OR k % 101 = 17 AS trunc, k % 101 = 17 AS noresp, k % 103 = 29 AS noarb,
         list_position({PRIOS}, pr) AS pidx,
         strftime(od, '%-d %B %Y') AS date_words,
         strftime(CAST(od + 30 AS DATE), '%-d %B %Y') AS due_words,
         [strftime(od, '%Y-%m-%d'), strftime(od, '%-d %B %Y'), strftime(od, '%B %-d %Y'), strftime(od, '%d/%m/%Y'),
          CASE WHEN day(od) > 12 THEN strftime(od, '%m/%d/%Y') ELSE strftime(od, '%-d %B %Y') END, strftime(od, '%d-%m-%Y'),
          strftime(od, '%b %-d %Y'), strftime(od, '%-d %b %Y'), strftime(od, '%-d %B %Y') || ' 14:05',
          strftime(od, '%-d') || 'th day of ' || strftime(od, '%B, %Y')][k % 10 + 1] AS unc_date,
         ['USD ', 'EUR ', '$', '£', 'MYR ', 'RM '][k % 6 + 1] AS currency,
         ['none', 'N/A', 'na', 'NULL', 'not provided', 'Not specified', 'not stated', 'not applicable', 'value not mentioned', 'unknown'][(k // 10) % 10 + 1] AS no_nation,
         format('{{:,.2f}}', tp) AS total_words, format('{{:,.2f}}', tp - 11.11) AS subtotal_words,
         CAST(printf('%.2f', tp) AS DOUBLE) AS gx
  FROM b0),
b AS (
  SELECT *, {PRIOS}[(pidx % 5) + 1] AS next_prio, {PRIOS}[((pidx + 1) % 5) + 1] AS third_prio,
    concat_ws(chr(10), 'ORDER CONFIRMATION',
      'Order number: ORD-' || k || '    Reference: PO-' || (k * 7 + 1000),
      'Customer: ' || c_name,
      CASE WHEN k % 31 <> 9 THEN 'Order placed on ' || date_words || '. Payment due ' || due_words || '.' END,
      CASE WHEN g_nation <> '' THEN 'Destination nation: ' || g_nation || '.' END,
      'Priority: ' || pr,
      'Suppliers: ' || CASE WHEN len(names) = 0 THEN 'none listed' ELSE array_to_string(names, ', ') END,
      'Subtotal: USD ' || subtotal_words,
      'TOTAL DUE: USD ' || total_words) AS doc
  FROM b1),
bd AS (
  SELECT *,
    list_transform(regexp_extract_all(doc, '[-+]?\d[\d,]*\.?\d*'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)) AS doc_nums,
    list_distinct(list_filter(string_split_regex(regexp_replace(lower(doc), '[^\p{{L}}\p{{N}}_\s&/@-]', ' ', 'g'), '\s+'), lambda x: x <> '')) AS dtok0
  FROM b),
bt AS (SELECT *, list_concat(dtok0, list_transform(dtok0, lambda x: rtrim(x, 's'))) AS dtok FROM bd),
"""


def _fields() -> str:
    """One row per (order, field) with raw and canonical values of each path."""
    nul_d, nul_x, nul_s = "CAST(NULL AS DATE)", "CAST(NULL AS DOUBLE)", "[]::VARCHAR[]"
    rows = []
    # 0 order_id
    # the arbiter's "constrained value" answers (rule 'c') are rendered from the
    # intended constrained value, also when the JSON text itself was truncated
    u0 = "CASE WHEN k % 19 = 6 THEN 'ORD' ELSE 'ORD-' || k END"
    con0 = f"CASE WHEN trunc THEN '' ELSE {u0} END"
    rows.append(f"""SELECT k, 0 AS ord, 'order_id' AS field, 'string' AS typ, true AS req, false AS multi,
      {con0} AS con_raw, CASE WHEN noresp THEN '' ELSE 'ORD-' || k END AS unc_raw,
      CASE {_arbk(0)} WHEN 't' THEN 'ORD-X' || k WHEN 'c' THEN {u0} ELSE 'ORD-' || k END AS arb_clean,
      lower({con0}) AS con_t, CASE WHEN noresp THEN '' ELSE 'ord-' || k END AS unc_t, 'ord-' || k AS gold_t,
      lower(CASE {_arbk(0)} WHEN 't' THEN 'ORD-X' || k WHEN 'c' THEN {u0} ELSE 'ORD-' || k END) AS arb_t,
      {nul_x} AS con_x, {nul_x} AS unc_x, {nul_x} AS gold_x, {nul_x} AS arb_x,
      {nul_d} AS con_d, {nul_d} AS unc_d, {nul_d} AS gold_d, {nul_d} AS arb_d,
      {nul_s} AS con_s, {nul_s} AS unc_s, {nul_s} AS gold_s, {nul_s} AS arb_s FROM bt""")
    # 1 customer
    cn = _cn("c_name")
    unc1 = f"CASE WHEN noresp THEN '' WHEN k % 37 = 11 THEN 'customer 999999999' ELSE {cn} END"
    rows.append(f"""SELECT k, 1, 'customer', 'string', true, false,
      CASE WHEN trunc THEN '' ELSE c_name END,
      CASE WHEN noresp THEN '' ELSE CASE WHEN k % 37 = 11 THEN 'customer#999999999' ELSE lower(c_name) END || ' .' END,
      CASE {_arbk(1)} WHEN 't' THEN 'Unlisted Customer' ELSE c_name END,
      CASE WHEN trunc THEN '' ELSE {cn} END, {unc1}, {cn},
      CASE {_arbk(1)} WHEN 't' THEN 'unlisted customer' ELSE {cn} END,
      {nul_x}, {nul_x}, {nul_x}, {nul_x}, {nul_d}, {nul_d}, {nul_d}, {nul_d},
      {nul_s}, {nul_s}, {nul_s}, {nul_s} FROM bt""")
    # 2 total
    udec = ("CASE WHEN k % 29 = 7 THEN NULL WHEN k % 11 = 3 THEN CAST(tp + 100 AS DECIMAL(18,2)) "
            "ELSE CAST(tp AS DECIMAL(18,2)) END")
    cdec = f"CASE WHEN trunc THEN NULL ELSE {udec} END"
    conx = f"CAST({cdec} AS DOUBLE)"
    ux = f"CAST({udec} AS DOUBLE)"
    ur = f"coalesce(CAST({udec} AS VARCHAR), '')"  # answer book renders the decimal text
    # Python's json reads numbers as floats and prints them with str()
    conr = f"coalesce(CAST(CAST({cdec} AS DOUBLE) AS VARCHAR), '')"
    uncx = "CASE WHEN noresp THEN NULL ELSE gx END"
    arbx = f"CASE {_arbk(2)} WHEN 't' THEN 1.0 WHEN 'c' THEN {ux} ELSE gx END"
    rows.append(f"""SELECT k, 2, 'total', 'number', true, false,
      {conr}, CASE WHEN noresp THEN '' ELSE currency || total_words END,
      CASE {_arbk(2)} WHEN 't' THEN '1.00' WHEN 'c' THEN {ur} ELSE total_words END,
      {_num_text(conx)}, {_num_text(uncx)}, {_num_text('gx')}, {_num_text(arbx)},
      {conx}, {uncx}, gx, {arbx}, {nul_d}, {nul_d}, {nul_d}, {nul_d},
      {nul_s}, {nul_s}, {nul_s}, {nul_s} FROM bt""")
    # 3 order_date (optional)
    ud = "CASE WHEN k % 13 = 4 THEN CAST(od + 1 AS DATE) ELSE od END"
    cond = f"CASE WHEN trunc THEN NULL ELSE {ud} END"
    arbd = f"CASE {_arbk(3)} WHEN 't' THEN CAST(od + 200 AS DATE) WHEN 'c' THEN {ud} ELSE od END"
    uncd = "CASE WHEN noresp THEN NULL ELSE od END"
    dt = lambda d: f"coalesce(strftime({d}, '%Y-%m-%d'), '')"
    rows.append(f"""SELECT k, 3, 'order_date', 'date', false, false,
      {dt(cond)}, CASE WHEN noresp THEN '' ELSE unc_date END,
      CASE {_arbk(3)} WHEN 't' THEN strftime(CAST(od + 200 AS DATE), '%-d %B %Y') WHEN 'c' THEN {dt(ud)} ELSE date_words END,
      {dt(cond)}, {dt(uncd)}, {dt('od')}, {dt(arbd)},
      {nul_x}, {nul_x}, {nul_x}, {nul_x}, {cond}, {uncd}, od, {arbd},
      {nul_s}, {nul_s}, {nul_s}, {nul_s} FROM bt""")
    # 4 priority (enum)
    u4 = "CASE WHEN k % 17 = 5 THEN next_prio ELSE pr END"
    con4 = f"CASE WHEN trunc THEN '' ELSE {u4} END"
    unc4 = "CASE WHEN noresp THEN '' ELSE pr END"
    arb4 = f"CASE {_arbk(4)} WHEN 't' THEN third_prio WHEN 'c' THEN {u4} ELSE pr END"
    rows.append(f"""SELECT k, 4, 'priority', 'enum', true, false,
      {con4}, {unc4}, {arb4}, lower({con4}), lower({unc4}), lower(pr), lower({arb4}),
      {nul_x}, {nul_x}, {nul_x}, {nul_x}, {nul_d}, {nul_d}, {nul_d}, {nul_d},
      {nul_s}, {nul_s}, {nul_s}, {nul_s} FROM bt""")
    # 5 nation (optional)
    u5 = "CASE WHEN g_nation <> '' THEN g_nation WHEN fab THEN 'Freedonia' ELSE '' END"
    con5 = f"CASE WHEN trunc THEN '' ELSE {u5} END"
    unc5 = "CASE WHEN noresp THEN '' WHEN g_nation <> '' THEN g_nation WHEN fab THEN 'Freedonia' ELSE no_nation END"
    arb5 = f"CASE {_arbk(5)} WHEN 't' THEN 'Atlantis' WHEN 'c' THEN {u5} ELSE CASE WHEN g_nation <> '' THEN g_nation ELSE 'NONE' END END"
    rows.append(f"""SELECT k, 5, 'nation', 'string', false, false,
      {con5}, {unc5}, {arb5}, lower({con5}),
      CASE WHEN {unc5} = no_nation THEN '' ELSE lower({unc5}) END, lower(g_nation),
      CASE WHEN {arb5} = 'NONE' THEN '' ELSE lower({arb5}) END,
      {nul_x}, {nul_x}, {nul_x}, {nul_x}, {nul_d}, {nul_d}, {nul_d}, {nul_d},
      {nul_s}, {nul_s}, {nul_s}, {nul_s} FROM bt""")
    # 6 suppliers (multi)
    ul = "CASE WHEN k % 23 = 8 THEN names[2:] ELSE names END"
    conl = f"CASE WHEN trunc THEN []::VARCHAR[] ELSE {ul} END"
    uncl = "CASE WHEN noresp THEN []::VARCHAR[] ELSE names END"
    arbs = f"CASE {_arbk(6)} WHEN 't' THEN ['unlisted supplier'] WHEN 'c' THEN {_set(ul)} ELSE {_set('names')} END"
    rows.append(f"""SELECT k, 6, 'suppliers', 'string', true, true,
      array_to_string({conl}, '; '), array_to_string(list_reverse({uncl}), '; '),
      CASE {_arbk(6)} WHEN 't' THEN 'Unlisted Supplier' WHEN 'c' THEN array_to_string({ul}, '; ') ELSE array_to_string(names, '; ') END,
      array_to_string({_set(conl)}, '; '), array_to_string({_set(uncl)}, '; '),
      array_to_string({_set('names')}, '; '), array_to_string({arbs}, '; '),
      {nul_x}, {nul_x}, {nul_x}, {nul_x}, {nul_d}, {nul_d}, {nul_d}, {nul_d},
      {_set(conl)}, {_set(uncl)}, {_set('names')}, {arbs} FROM bt""")
    return "\nUNION ALL\n".join(rows)


def _ratio(t: str) -> str:
    """Share of the tokens of canonical text ``t`` found in the document tokens."""
    return (f"CASE WHEN {t} = '' THEN 1.0 ELSE "
            f"len(list_filter(string_split({t}, ' '), lambda x: list_contains(dtok, x) OR list_contains(dtok, rtrim(x, 's'))))"
            f" / len(string_split({t}, ' ')) END")


def _support(prefix: str) -> str:
    """Support of the value whose canonical parts are ``<prefix>_t/_x/_d/_s``."""
    t, x, d, s = (f"{prefix}_{c}" for c in "txds")
    return f"""CASE WHEN multi THEN CASE WHEN len({s}) = 0 THEN 1.0 ELSE list_min(list_transform({s}, lambda e: {_ratio('e')})) END
      WHEN typ = 'number' THEN CASE WHEN {x} IS NULL THEN 1.0 WHEN list_contains(doc_nums, {x}) THEN 1.0 ELSE 0.0 END
      WHEN typ = 'date' THEN CASE WHEN {d} IS NULL THEN 1.0
                                  WHEN k % 31 <> 9 AND ({d} = od OR {d} = CAST(od + 30 AS DATE)) THEN 1.0 ELSE 0.0 END
      ELSE {_ratio(t)} END"""


def _jacc(a: str, b: str) -> str:
    ta, tb = f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))"
    return f"(1.0 - len(list_intersect({ta}, {tb})) / len(list_distinct(list_concat({ta}, {tb}))))"


def truth(repair: bool = False) -> str:
    """WITH-clause body ending in ``t`` (one row per order and field)."""
    key = lambda p: f"CASE WHEN multi THEN {p}_s ELSE [{p}_t] END"
    return BASE + f"""
f0 AS ({_fields()}),
f1 AS (
  SELECT f0.*, bt.doc, bt.doc_nums, bt.dtok, bt.od, bt.noresp, bt.noarb,
    {key('con')} AS con_key, {key('unc')} AS unc_key, {key('gold')} AS gold_key,
    CASE WHEN noarb THEN NULL ELSE {key('arb')} END AS arb_key,
    con_t = '' AS con_e, unc_t = '' AS unc_e
  FROM f0 JOIN bt USING (k)),
f2 AS (
  SELECT *,
    CASE WHEN con_e OR unc_e THEN CASE WHEN req OR con_e <> unc_e THEN 1.0 ELSE 0.0 END
         WHEN con_key = unc_key THEN 0.0
         WHEN multi THEN 1.0 - len(list_intersect(con_s, unc_s)) / len(list_distinct(list_concat(con_s, unc_s)))
         WHEN typ = 'string' THEN {_jacc('con_t', 'unc_t')}
         WHEN typ = 'number' THEN 0.5 + 0.5 * least(1.0, abs(con_x - unc_x) / greatest(abs(con_x), abs(unc_x)))
         WHEN typ = 'date' THEN 0.5 + 0.5 * least(1.0, abs(con_d - unc_d) / 365.0)
         ELSE 1.0 END AS score
  FROM f1),
f3 AS (
  SELECT *, CASE WHEN con_e OR unc_e THEN req OR con_e <> unc_e ELSE score >= 0.5 END AS flagged FROM f2),
f4 AS (
  SELECT *,
    CASE WHEN NOT flagged THEN 'agreement' WHEN arb_key = unc_key OR arb_key = con_key THEN 'majority'
         ELSE 'split-kept' END AS resolution,
    flagged AND coalesce(arb_key = unc_key, false) AS from_arb
  FROM f3),
f5 AS (
  SELECT *,
    CASE WHEN from_arb THEN arb_key ELSE con_key END AS final_key,
    CASE WHEN from_arb THEN arb_clean ELSE con_raw END AS final_raw,
    CASE WHEN from_arb THEN arb_t ELSE con_t END AS fin_t,
    CASE WHEN from_arb THEN arb_x ELSE con_x END AS fin_x,
    CASE WHEN from_arb THEN arb_d ELSE con_d END AS fin_d,
    CASE WHEN from_arb THEN arb_s ELSE con_s END AS fin_s
  FROM f4),
f6 AS (
  SELECT *, {_support('fin')} AS support, {_support('gold')} AS gold_support FROM f5),
t AS (
  SELECT *, 'tpch' AS run_id, k AS doc_id, k AS doc_idx, support < 0.5 AS ungrounded,
    {'(NOT req) AND support < 0.5' if repair else 'false'} AS repaired,
    CASE WHEN {'(NOT req) AND support < 0.5' if repair else 'false'}
         THEN CASE WHEN multi THEN []::VARCHAR[] ELSE [''] END ELSE final_key END AS kept_key,
    con_key = gold_key AS con_ok, unc_key = gold_key AS unc_ok,
    CASE resolution WHEN 'agreement' THEN 1.0 WHEN 'majority' THEN 0.7 ELSE 0.3 END * (0.5 + 0.5 * support) AS confidence
  FROM f6),
tt AS (SELECT *, kept_key = gold_key AS final_ok, NOT (con_key = gold_key) AND unc_key = gold_key AS corrupted FROM t)
"""


def with_truth(select: str, repair: bool = False) -> str:
    return "WITH " + truth(repair) + select


PER_DOC = """,
pd AS (
  SELECT run_id, doc_id, count(*) AS n, count(*) FILTER (WHERE con_ok) AS cc, count(*) FILTER (WHERE final_ok) AS fc,
         count(*) FILTER (WHERE corrupted) AS nc, count(*) FILTER (WHERE flagged) AS nf,
         count(*) FILTER (WHERE flagged AND corrupted) AS tp, count(*) FILTER (WHERE resolution = 'split-kept') AS low,
         count(*) FILTER (WHERE ungrounded) AS ug
  FROM tt GROUP BY run_id, doc_id),
pdr AS (
  SELECT *, cc / n AS con_acc, fc / n AS final_acc,
    CASE WHEN nf = 0 THEN CASE WHEN nc = 0 THEN 1.0 ELSE 0.0 END ELSE tp / nf END AS p,
    CASE WHEN nf = 0 THEN CASE WHEN nc = 0 THEN 1.0 ELSE 0.0 END WHEN nc = 0 THEN 1.0 ELSE tp / nc END AS r
  FROM pd)
"""

REPORT = """
SELECT run_id, docs, docs * 7 AS fields_total, round(ca, 6) AS constrained_acc, round(fa, 6) AS final_acc,
  round(fcor / (docs * 7), 6) AS corruption_rate, round(fp, 6) AS flag_precision, round(fr, 6) AS flag_recall,
  round(CASE WHEN ffl = 0 THEN 1.0 ELSE ftp / ffl END, 6) AS flag_precision_micro,
  round(CASE WHEN fcor = 0 THEN 1.0 ELSE ftp / fcor END, 6) AS flag_recall_micro,
  ftp AS flag_tp, ffl AS flag_flagged, fcor AS flag_corrupted,
  docs * 2 + ffl AS llm_calls, docs * 9 AS full_verify_calls, round(1.0 - (docs * 2 + ffl) / (docs * 9), 6) AS calls_saved,
  low AS low_confidence, ug AS ungrounded, round(ug / (docs * 7), 6) AS ungrounded_rate
FROM (SELECT run_id, count(*) AS docs, avg(con_acc) AS ca, avg(final_acc) AS fa, sum(nc) AS fcor, sum(nf) AS ffl,
             sum(tp) AS ftp, avg(p) AS fp, avg(r) AS fr, sum(low) AS low, sum(ug) AS ug FROM pdr GROUP BY run_id)
"""

SWEEP = """,
th AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS threshold),
sw AS (
  SELECT f2.k AS doc_id, th.threshold,
    CASE WHEN con_e OR unc_e THEN req OR con_e <> unc_e ELSE score >= th.threshold END AS fl,
    con_key, unc_key, gold_key, arb_key
  FROM f2 CROSS JOIN th),
sw2 AS (
  SELECT *, CASE WHEN fl AND coalesce(arb_key = unc_key, false) THEN arb_key ELSE con_key END = gold_key AS ok,
         NOT (con_key = gold_key) AND unc_key = gold_key AS cor FROM sw),
swd AS (
  SELECT doc_id, threshold, count(*) AS n, count(*) FILTER (WHERE ok) AS fc, count(*) FILTER (WHERE fl) AS nf,
         count(*) FILTER (WHERE cor) AS nc, count(*) FILTER (WHERE fl AND cor) AS tp FROM sw2 GROUP BY doc_id, threshold)
SELECT threshold, round(avg(fc / n), 6) AS final_acc,
  round(avg(CASE WHEN nf = 0 THEN CASE WHEN nc = 0 THEN 1.0 ELSE 0.0 END ELSE tp / nf END), 6) AS flag_precision,
  round(avg(CASE WHEN nf = 0 THEN CASE WHEN nc = 0 THEN 1.0 ELSE 0.0 END WHEN nc = 0 THEN 1.0 ELSE tp / nc END), 6) AS flag_recall,
  count(*) * 2 + sum(nf) AS llm_calls
FROM swd GROUP BY threshold
"""

AURC = """,
sig AS (
  SELECT 'combined' AS signal, confidence AS score, NOT final_ok AS wrong, doc_idx, ord FROM tt
  UNION ALL SELECT 'flag', CASE WHEN flagged THEN 0.0 ELSE 1.0 END, NOT final_ok, doc_idx, ord FROM tt
  UNION ALL SELECT 'support', support, NOT final_ok, doc_idx, ord FROM tt),
rk AS (
  SELECT signal, row_number() OVER w AS i, sum(CAST(wrong AS INTEGER)) OVER w AS errs FROM sig
  WINDOW w AS (PARTITION BY signal ORDER BY score DESC, doc_idx, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
au AS (SELECT signal, round(avg(errs / i), 6) AS aurc FROM rk GROUP BY signal),
wide AS (SELECT max(aurc) FILTER (WHERE signal = 'combined') AS combined, max(aurc) FILTER (WHERE signal = 'flag') AS flag,
                max(aurc) FILTER (WHERE signal = 'support') AS support FROM au)
SELECT (SELECT round(avg(CASE WHEN final_ok THEN 0.0 ELSE 1.0 END), 6) FROM tt) AS random, flag, support, combined,
  CASE WHEN combined < least(flag, support) THEN 'combined BEST'
       WHEN combined <= least(flag, support) + 1e-9 THEN 'single signal suffices' ELSE 'combined WORSE' END AS verdict
FROM wide
"""

CLAUSE = r"""
WITH kw AS (SELECT unnest(['governed by', 'governing law', 'laws of the', 'term of this agreement',
                           'shall remain in effect', 'shall terminate', 'period of']) AS kw),
d AS (SELECT doc_id, replace(replace(replace(text, '\n', chr(10)), '\t', chr(9)), '\r', '') AS t FROM documents),
l AS (SELECT doc_id, t, length(t) AS L, substring(t, 3001, length(t) - 4500) AS mid FROM d WHERE length(t) > 4500),
sp AS (SELECT l.doc_id, greatest(instr(lower(l.mid), kw.kw) - 1 - 350, 0) AS a, instr(lower(l.mid), kw.kw) - 1 + 700 AS b
       FROM l, kw WHERE instr(lower(l.mid), kw.kw) > 0),
o AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM sp),
g AS (SELECT *, sum(CASE WHEN pm IS NULL OR a > pm THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS gi FROM o),
m AS (SELECT doc_id, gi, min(a) AS a, max(b) AS b FROM g GROUP BY doc_id, gi),
w AS (SELECT l.doc_id, sum(length(substring(l.mid, m.a + 1, m.b - m.a))) AS kept, string_agg(substring(l.mid, m.a + 1, m.b - m.a), chr(10) || '[...]' || chr(10) ORDER BY m.a) AS win
      FROM l JOIN m USING (doc_id) GROUP BY l.doc_id),
r AS (
  SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.t ELSE
    array_to_string(list_filter([substring(d.t, 1, 3000), coalesce(w.win, ''), substring(d.t, length(d.t) - 1499, 1500)], lambda p: p <> ''),
                    chr(10) || '[...]' || chr(10)) END AS reduced,
    CAST(CASE WHEN l.doc_id IS NULL THEN 0 ELSE l.L - 4500 - coalesce(w.kept, 0) END AS INTEGER) AS dropped
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN w USING (doc_id))
SELECT doc_id, length(reduced) AS reduced_len, sha256(reduced) AS reduced_sha, dropped FROM r
"""


def _requests() -> str:
    """The prompts as text: every line that stands before a document, written out."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    prio = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    told = {"order_id": "order number, ORD-<n>", "customer": "customer name", "total": "total amount due", "order_date": "date the order was placed",
            "nation": "destination nation", "suppliers": "supplier names"}
    form = ('{"type": "object", "properties": {"order_id": {"type": "string", "description": "order number, ORD-<n>"}, '
            '"customer": {"type": "string", "description": "customer name"}, "total": {"type": "number", "description": "total amount due"}, '
            '"order_date": {"type": "string", "format": "date", "description": "date the order was placed"}, '
            '"priority": {"type": "string", "enum": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}, '
            '"nation": {"type": "string", "description": "destination nation"}, '
            '"suppliers": {"type": "array", "items": {"type": "string"}, "description": "supplier names"}}, '
            '"required": ["order_id", "customer", "total", "priority", "suppliers"], "additionalProperties": false}')
    lines = ["- order_id (string) — order number, ORD-<n>", "- customer (string) — customer name", "- total (number) — total amount due",
             "- order_date (date) — date the order was placed", f"- priority (enum) one of {prio}", "- nation (string) — destination nation",
             "- suppliers (string) [list ALL values, separated by '; '] — supplier names"]
    block = "FIELDS:\n" + "\n".join(lines) + "\nDOCUMENT:\n"
    con = ("Extract the fields below from the document. Respond with a single JSON object matching this schema, nothing else.\n"
           f"JSON SCHEMA:\n{form}\n{block}")
    unc = ("Read the document and report every field listed below, one per line, using the exact field name, "
           f"e.g. 'order_id: <value>'. Plain text only.\n{block}")
    types = {"order_id": "string", "customer": "string", "total": "number", "order_date": "date", "priority": "enum", "nation": "string", "suppliers": "string"}
    heads = " ".join(f"WHEN '{f}' THEN " + q(
        "From the document, what is the value of this field? Answer with the value only, nothing else.\n"
        f"FIELD: {f}\nTYPE: {t}\n" + (f"DESCRIPTION: {told[f]}\n" if f in told else "")
        + ("If the document does not state it, answer NONE.\n" if f in ("order_date", "nation") else "") + "DOCUMENT:\n") for f, t in types.items())
    return f"""SELECT 'tpch' AS run_id, doc_id, path, field, path = 'constrained' AS force_json, sha256(head || doc || chr(10)) AS prompt_sha FROM (
        SELECT k AS doc_id, 'constrained' AS path, '' AS field, {q(con)} AS head, doc FROM bt
        UNION ALL SELECT k, 'unconstrained', '', {q(unc)}, doc FROM bt
        UNION ALL SELECT k, 'arbiter', field, CASE field {heads} END, doc FROM tt WHERE flagged)"""


REQUESTS = _requests()

#: What the recorded answers say, field by field, as they were written.
ANSWERS = "raws AS (" + " UNION ALL ".join(f"SELECT k, {i} AS ord, CASE WHEN noarb THEN NULL ELSE CASE {_arbk(i)} WHEN 't' THEN {third} WHEN 'c' THEN {con} ELSE {gold} END END AS arb_raw FROM bt"
                                            for i, (third, con, gold) in enumerate([
    ("'ORD-X' || k", "CASE WHEN k % 19 = 6 THEN 'ORD' ELSE 'ORD-' || k END", "'\"ORD-' || k || '\".'"),
    ("'Unlisted Customer'", "c_name", "c_name || '.'"),
    ("'The total is 1.00.'", "coalesce(CAST(CASE WHEN k % 29 = 7 THEN NULL WHEN k % 11 = 3 THEN CAST(tp + 100 AS DECIMAL(18,2)) ELSE CAST(tp AS DECIMAL(18,2)) END AS VARCHAR), '')",
     "'The total is ' || total_words || '.'"),
    ("strftime(CAST(od + 200 AS DATE), '%-d %B %Y')", "strftime(CASE WHEN k % 13 = 4 THEN CAST(od + 1 AS DATE) ELSE od END, '%Y-%m-%d')", "date_words || '.'"),
    ("third_prio", "CASE WHEN k % 17 = 5 THEN next_prio ELSE pr END", "'The priority is ' || pr || '.'"),
    ("'Atlantis'", "CASE WHEN g_nation <> '' THEN g_nation WHEN fab THEN 'Freedonia' ELSE '' END", "CASE WHEN g_nation <> '' THEN g_nation ELSE 'NONE' END"),
    ("'Unlisted Supplier'", "array_to_string(CASE WHEN k % 23 = 8 THEN names[2:] ELSE names END, '; ')", "array_to_string(names, '; ')")])) + ")"


def _payloads() -> str:
    """The stages' JSON texts, put together from the truth."""
    js = lambda x: f"CAST(to_json({x}) AS VARCHAR)"
    num = lambda x: f"CAST(round({x}, 6) AS VARCHAR)"
    entry = lambda value: f"'{{' || string_agg({js('field')} || ':' || {js(value)}, ',' ORDER BY ord) || '}}'"

    def listed(*pairs: tuple[str, str], when: str = "true") -> str:
        body = " || ',' || ".join(f"'\"{name}\":' || {value}" for name, value in (("ord", "CAST(ord AS VARCHAR)"), ("field", js("field")), *pairs))
        return f"'[' || coalesce(string_agg('{{' || {body} || '}}', ',' ORDER BY ord) FILTER (WHERE {when}), '') || ']'"
    bit = lambda x: f"CASE WHEN {x} THEN 'true' ELSE 'false' END"
    specs = ",".join('{"name":"%s","type":"%s","required":%s,"multi":%s}' % x for x in (
        ("order_id", "string", "true", "false"), ("customer", "string", "true", "false"), ("total", "number", "true", "false"), ("order_date", "date", "false", "false"),
        ("priority", "enum", "true", "false"), ("nation", "string", "false", "false"), ("suppliers", "string", "true", "true")))
    gold = "CASE ord WHEN 0 THEN 'ORD-' || k WHEN 1 THEN c_name WHEN 2 THEN printf('%.2f', tp) WHEN 3 THEN strftime(od, '%Y-%m-%d') WHEN 4 THEN pr WHEN 5 THEN g_nation ELSE array_to_string(names, '; ') END"
    flat = lambda p: f"CASE WHEN multi THEN lower(replace(replace({p}_raw, '#', ' '), ';', '')) ELSE {p}_t END"
    of_doc = {
        (0, "source"): f"'{{\"schema\":\"orders_audit\",\"fields\":[{specs}],\"gold\":' || {entry('gold_raw')} || '}}'",
        (1, "constrained"): entry("con_raw"), (2, "unconstrained"): entry("unc_raw"),
        (3, "normalize"): listed(("con_n", js(flat("con"))), ("unc_n", js(flat("unc")))),
        (4, "disagree"): listed(("score", num("score")), when="flagged"),
        (12, "arbiter_done"): listed(("final", js("final_raw")), ("resolution", js("resolution")), ("confident", bit("resolution <> 'split-kept'"))),
        (13, "ground"): listed(("support", num("support")), ("ungrounded", bit("ungrounded")), ("repaired", bit("repaired"))),
        (14, "kept"): listed(("kept", js("final_raw")), ("confidence", num("confidence")), ("changed", bit("NOT (kept_key = con_key)")))}
    stages = " UNION ALL ".join(f"SELECT doc_id, {seq} AS seq, '{stage}' AS stage, {text} AS payload FROM x GROUP BY doc_id" for (seq, stage), text in of_doc.items())
    answer = f"'{{\"field\":' || {js('field')} || coalesce(',\"arb_raw\":' || {js('arb_raw')}, '') || ',\"final\":' || {js('final_raw')} || ',\"resolution\":' || {js('resolution')} || '}}'"
    return f""", {ANSWERS}, x AS (SELECT tt.*, raws.arb_raw, {gold} AS gold_raw FROM tt JOIN raws USING (k, ord) JOIN (SELECT k, c_name, tp, pr, g_nation, names FROM bt) USING (k))
        SELECT doc_id, CAST(seq AS INTEGER) AS seq, stage, sha256(payload) AS payload_sha FROM ({stages} UNION ALL SELECT doc_id, 5 + ord, 'arbiter_field', {answer} FROM x WHERE flagged)"""


def _bootstrap(seed: int = 0, n_boot: int = 10000) -> str:
    """Replicates by the same numbers: 32-bit arithmetic of document and replicate against the Poisson distribution."""
    import math

    def mixed(source: str, keep: str, x: str, out: str) -> str:
        first = f"(xor({x}, {x} >> 16) * 569420461) % 4294967296"
        return (f"SELECT {keep}, xor(b, b >> 15) AS {out} FROM (SELECT {keep}, (xor(a, a >> 15) * 1935289751) % 4294967296 AS b FROM (SELECT {keep}, {first} AS a FROM ({source})))")
    limits = [int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 65536) for k in range(8)]
    drawn = " + ".join(f"CAST((x >> 16) >= {t} AS INTEGER)" for t in limits)
    docs = mixed(f"SELECT final_acc, (doc_id % 4294967291 + {seed * 40503}) % 4294967296 AS x FROM pdr", "final_acc", "x", "d")
    reps = mixed(f"SELECT rep, rep + 1540483477 AS x FROM range({n_boot}) r(rep)", "rep", "x", "r")
    both = mixed(f"SELECT final_acc, rep, (d + r) % 4294967296 AS x FROM ({docs}), ({reps})", "final_acc, rep", "x", "x")
    return f""",
        rp AS (SELECT rep, sum(w * final_acc) / sum(w) AS m FROM (SELECT final_acc, rep, {drawn} AS w FROM ({both})) GROUP BY rep),
        rr AS (SELECT m, row_number() OVER (ORDER BY m, rep) AS rk FROM rp)
        SELECT (SELECT round(avg(final_acc), 6) FROM pdr) AS mean, round(max(m) FILTER (WHERE rk = {int(0.025 * n_boot) + 1}), 6) AS lo95,
          round(max(m) FILTER (WHERE rk = {int(0.975 * n_boot) + 1}), 6) AS hi95, (SELECT count(*) FROM pdr) AS docs, {n_boot} AS n_boot FROM rr"""


def _both_runs(select: str) -> str:
    """The same of the run without and of the run with repair."""
    return " UNION ALL ".join(f"SELECT '{run}' AS run_id, * FROM ({with_truth(select, repair)})" for run, repair in (("plain", False), ("repair", True)))


LEDGER = """,
  asked AS (SELECT r.doc_id, r.field, r.prompt_sha, bt.doc FROM (""" + REQUESTS + """) r JOIN bt ON bt.k = r.doc_id WHERE path = 'arbiter'),
  line AS (SELECT *, CASE field WHEN 'order_id' THEN 'Order number: (\\S+)' WHEN 'customer' THEN 'Customer: (.*)' WHEN 'total' THEN 'TOTAL DUE: (.*)'
     WHEN 'order_date' THEN 'Order placed on (.*)\\. Payment' WHEN 'priority' THEN 'Priority: (.*)' WHEN 'nation' THEN 'Destination nation: (.*)\\.' ELSE 'Suppliers: (.*)' END AS p FROM asked)
  SELECT 'tpch' AS run_id, doc_id, field, prompt_sha, CASE WHEN doc_id % 106 = 8 THEN NULL WHEN regexp_matches(doc, p) THEN regexp_extract(doc, p, 1) ELSE 'NONE' END AS raw,
    CASE WHEN doc_id % 106 = 8 THEN 'TimeoutError: page' END AS error, CAST(CASE WHEN doc_id % 106 = 8 THEN 4 WHEN doc_id % 53 = 8 THEN 2 ELSE 1 END AS BIGINT) AS tries,
    CAST(CASE WHEN doc_id % 53 = 8 THEN 2 ELSE 1 END AS BIGINT) AS calls FROM line"""


CANON = r"""
WITH d AS (SELECT doc_id, text || ['', ' Twelve months, Limited', ': the Società CORPORATION', ' (held by X) L. l. C', ' Größe ÉTÉ one, two/three seven'][doc_id % 5 + 1] AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, replace(lower(trim(regexp_replace(regexp_replace(t, '[^\p{L}\p{M}\p{N}_\s&/@-]', ' ', 'g'), '\s+', ' ', 'g'))), 'ß', 'ss') AS t FROM d),
w AS (SELECT doc_id, array_to_string(list_transform(string_split(t, ' '), lambda x: CASE x WHEN 'one' THEN '1' WHEN 'two' THEN '2' WHEN 'three' THEN '3' WHEN 'four' THEN '4' WHEN 'five' THEN '5'
        WHEN 'six' THEN '6' WHEN 'seven' THEN '7' WHEN 'eight' THEN '8' WHEN 'nine' THEN '9' WHEN 'ten' THEN '10' WHEN 'eleven' THEN '11' WHEN 'twelve' THEN '12' ELSE x END), ' ') AS t FROM p),
l AS (SELECT doc_id, CASE WHEN regexp_matches(t, '(^| )incorporated$') THEN left(t, length(t) - 12) || 'inc' WHEN regexp_matches(t, '(^| )corporation$') THEN left(t, length(t) - 11) || 'corp'
        WHEN regexp_matches(t, '(^| )limited$') THEN left(t, length(t) - 7) || 'ltd' WHEN regexp_matches(t, '(^| )company$') THEN left(t, length(t) - 7) || 'co' ELSE t END AS t FROM w),
s AS (SELECT doc_id, t, regexp_extract(t, '(?:^| )((?:[a-z] )+[a-z])$', 1) AS tail FROM l),
r AS (SELECT doc_id, CASE WHEN tail = '' THEN t ELSE left(t, length(t) - length(tail)) || replace(tail, ' ', '') END AS t FROM s)
SELECT doc_id, CAST(length(t) AS INTEGER) AS chars, sha256(t) AS canon_sha FROM r
"""


def oracle_sql() -> dict[str, str]:
    T = with_truth
    fld = "SELECT doc_id, field, "
    q = {
        "parse_json_path": T(fld + "con_raw AS value FROM tt WHERE NOT noresp"),
        "parse_freeform_path": T(fld + "unc_raw AS value FROM tt WHERE NOT noresp"),
        "canon_number": T("SELECT doc_id, con_x AS con_num, unc_x AS unc_num, gold_x AS gold_num FROM tt WHERE ord = 2"),
        "canon_date": T("SELECT doc_id, con_d AS con_dt, unc_d AS unc_dt, gold_d AS gold_dt FROM tt WHERE ord = 3"),
        "canon_string": T(fld + "con_t AS con_n, unc_t AS unc_n, gold_t AS gold_n FROM tt WHERE ord IN (0, 1, 4, 5)"),
        "canon_set": T("SELECT doc_id, con_t AS con_disp, unc_t AS unc_disp, gold_t AS gold_disp FROM tt WHERE ord = 6"),
        "canon_documents": CANON.replace("\\\\", "\\"),
        "absence": T(fld + "ord = 5 AND unc_t = '' AS absent FROM tt WHERE NOT req AND NOT noresp"),
        "disagreement": T(fld + "round(score, 6) AS score FROM tt"),
        "flags": T(fld + "flagged FROM tt"),
        "flag_worklist": T("SELECT run_id, doc_id, field FROM tt WHERE flagged"),
        "clean_answer": T(fld + "arb_clean AS cleaned FROM tt WHERE NOT noarb"),
        "resolve": T(fld + "resolution, resolution <> 'split-kept' AS confident, "
                     "array_to_string(final_key, '; ') AS final_canon FROM tt"),
        "final_record": T("SELECT doc_id, " + ", ".join(
            f"max(final_raw) FILTER (WHERE ord = {i}) AS {n}" for i, n in enumerate(
                ["order_id", "customer", "total", "order_date", "priority", "nation", "suppliers"]))
            + " FROM tt GROUP BY doc_id"),
        "support": T(fld + "round(support, 6) AS support FROM tt"),
        "support_postings": T(fld + "round(support, 6) AS support FROM tt"),
        "ground_repair": T(fld + "repaired, array_to_string(kept_key, '; ') AS kept_canon FROM tt", repair=True),
        "ungrounded_gate": T("SELECT run_id, count(*) FILTER (WHERE ungrounded) AS ungrounded, count(*) AS fields, "
                             "round(count(*) FILTER (WHERE ungrounded) / count(*), 6) AS rate, "
                             "CASE WHEN round(count(*) FILTER (WHERE ungrounded) / count(*), 6) >= 0.10 "
                             "THEN 'FABRICATING' ELSE 'reliable' END AS band FROM tt GROUP BY run_id"),
        "evidence_span": T(fld + "CASE WHEN length(trim(final_raw)) >= 3 THEN instr(lower(doc), lower(trim(final_raw))) "
                           "ELSE 0 END AS span_start, CASE WHEN length(trim(final_raw)) >= 3 AND "
                           "instr(lower(doc), lower(trim(final_raw))) > 0 THEN instr(lower(doc), lower(trim(final_raw)))"
                           " + length(trim(final_raw)) - 1 ELSE 0 END AS span_end FROM tt"),
        "confidence": T(fld + "round(confidence, 6) AS confidence FROM tt"),
        "review_topk": T(fld + "round(confidence, 6) AS confidence FROM tt QUALIFY row_number() OVER (ORDER BY tt.confidence, doc_idx, ord) "
                         "<= ceil(0.05 * count(*) OVER ())"),
        "accuracy_by_doc": T(PER_DOC + "SELECT doc_id, round(con_acc, 6) AS con_acc, round(final_acc, 6) AS final_acc FROM pdr"),
        "accuracy_by_field": T("SELECT field, count(*) AS n, round(avg(CASE WHEN con_ok THEN 1.0 ELSE 0.0 END), 6) AS constrained_acc, "
                               "round(avg(CASE WHEN final_ok THEN 1.0 ELSE 0.0 END), 6) AS final_acc, "
                               "count(*) FILTER (WHERE gold_t = '') AS gold_absent, "
                               "count(*) FILTER (WHERE gold_t = '' AND final_ok) AS absent_right FROM tt GROUP BY field"),
        "corrupted": T("SELECT doc_id, field FROM tt WHERE corrupted"),
        "flag_pr_by_doc": T(PER_DOC + "SELECT doc_id, round(p, 6) AS flag_precision, round(r, 6) AS flag_recall FROM pdr"),
        "run_report": T(PER_DOC + REPORT),
        "run_report_repair": T(PER_DOC + REPORT, repair=True),
        "sweep": T(SWEEP),
        "tripwire": T("SELECT run_id, count(*) FILTER (WHERE fin_t = '') AS absent, "
                      "count(*) AS fields, count(*) FILTER (WHERE fin_t = '') "
                      "> floor(count(*) / 2) AS warn FROM tt GROUP BY run_id"),
        "ground_confusion": T("""SELECT run_id, caught, missed, false_alarm, clean,
            round(CASE WHEN caught + missed > 0 THEN caught / (caught + missed) ELSE 0.0 END, 6) AS recall,
            round(CASE WHEN caught + false_alarm > 0 THEN caught / (caught + false_alarm) ELSE 0.0 END, 6) AS precision,
            round(CASE WHEN false_alarm + clean > 0 THEN false_alarm / (false_alarm + clean) ELSE 0.0 END, 6) AS fpr
          FROM (SELECT run_id, count(*) FILTER (WHERE NOT final_ok AND ungrounded) AS caught,
                  count(*) FILTER (WHERE NOT final_ok AND NOT ungrounded) AS missed,
                  count(*) FILTER (WHERE final_ok AND ungrounded) AS false_alarm,
                  count(*) FILTER (WHERE final_ok AND NOT ungrounded) AS clean FROM tt GROUP BY run_id)"""),
        "repair_what_if": T("""SELECT run_id, fields, before, after, fixed, broken, gold_not_in_doc,
            round(before / fields, 6) AS acc_before, round(after / fields, 6) AS acc_after FROM (
          SELECT run_id, count(*) AS fields, count(*) FILTER (WHERE final_ok) AS before,
            count(*) FILTER (WHERE oa) AS after, count(*) FILTER (WHERE oa AND NOT final_ok) AS fixed,
            count(*) FILTER (WHERE final_ok AND NOT oa) AS broken,
            count(*) FILTER (WHERE final_ok AND NOT oa AND gold_support < 0.5) AS gold_not_in_doc
          FROM (SELECT *, CASE WHEN NOT req AND ungrounded THEN len(list_filter(gold_key, lambda x: x <> '')) = 0
                               ELSE final_ok END AS oa FROM tt) GROUP BY run_id)"""),
        "risk_coverage": _both_runs(AURC),
        "bootstrap_ci": _both_runs(PER_DOC + _bootstrap()),
        "answer_ledger": T(LEDGER),
        "counterfactual": T("""SELECT doc_id, round(count(*) FILTER (WHERE con_ok) / count(*), 6) AS baseline_acc,
            round(count(*) FILTER (WHERE final_ok) / count(*), 6) AS final_acc,
            coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE final_ok AND NOT con_ok), '') AS repaired,
            coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE con_ok AND NOT final_ok), '') AS broken
          FROM tt GROUP BY doc_id"""),
        "changed_fields": T("SELECT field, count(*) FILTER (WHERE NOT (kept_key = con_key)) AS changed FROM tt GROUP BY field"),
        "cost_points": T(PER_DOC + "SELECT run_id, final_acc, constrained_acc, llm_calls, full_verify_calls, calls_saved, "
                         "low_confidence FROM (" + REPORT + ")"),
        "breakdown_cube": T("SELECT run_id, field, count(*) AS n, count(*) FILTER (WHERE final_ok) AS final_correct, "
                            "count(*) FILTER (WHERE con_ok) AS con_correct FROM tt GROUP BY CUBE (run_id, field)"),
        "corpus_shape": "SELECT count(*) AS records, count(*) FILTER (WHERE trim(text) <> '') AS non_blank, "
                        "count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, "
                        "min(length(text)) AS min_chars, max(length(text)) AS max_chars FROM documents",
        "escape_residue": "SELECT CAST(sum((length(text) - length(replace(text, '\\n', ''))) / 2) AS BIGINT) AS literal_newlines, "
                          "CAST(sum((length(text) - length(replace(text, '\\t', ''))) / 2) AS BIGINT) AS literal_tabs, "
                          "count(*) FILTER (WHERE instr(text, chr(10)) > 0) AS docs_with_newline FROM documents",
        "fingerprint": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
        "corpus_sample": "SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank "
                         "FROM documents QUALIFY rank <= 6",
        "clause_reduce": CLAUSE,
        "gold_absence": "WITH " + BASE.rstrip().rstrip(",") + """
          SELECT field, count(*) AS n, sum(absent) AS absent FROM (
            SELECT 'order_id' AS field, 0 AS absent FROM b UNION ALL SELECT 'customer', 0 FROM b
            UNION ALL SELECT 'total', 0 FROM b UNION ALL SELECT 'order_date', 0 FROM b
            UNION ALL SELECT 'priority', 0 FROM b
            UNION ALL SELECT 'nation', CASE WHEN g_nation = '' THEN 1 ELSE 0 END FROM b
            UNION ALL SELECT 'suppliers', CASE WHEN len(names) = 0 THEN 1 ELSE 0 END FROM b) GROUP BY field""",
        "label_parse": "WITH " + BASE.rstrip().rstrip(",") + """
          SELECT k AS doc_id, 'ORD-' || k AS order_id, c_name AS customer, CASE WHEN k % 41 = 7 THEN '0.00' ELSE printf('%.2f', tp) END AS total,
                 CASE WHEN k % 41 <> 7 AND k % 43 = 5 THEN '' ELSE strftime(od, '%Y-%m-%d') END AS order_date, pr AS priority,
                 replace(g_nation, '_', ' ') AS nation, array_to_string(names, '; ') AS suppliers FROM b""",
        "provenance_diff": "SELECT count(*) AS total, count(*) AS order_id_match, count(*) AS customer_match, count(*) AS priority_match, "
                           "count(*) FILTER (WHERE o_orderkey % 41 = 7 OR o_orderkey % 43 <> 5) AS order_date_match, count(*) AS nation_match, "
                           "count(*) FILTER (WHERE o_orderkey % 41 <> 7 OR round(o_totalprice, 2) = 0) AS total_match, count(*) AS suppliers_match FROM orders",
        "corpus_digest": "SELECT count(*) AS records, " + " || '-' || ".join(
            f"CAST(sum(CAST(('0x' || substr(h, {at}, 16)) AS UBIGINT)) AS VARCHAR)" for at in (1, 17, 33, 49))
            + " AS digest FROM (SELECT sha256(doc_id || ':' || sha256(text)) AS h FROM documents)",
        "corpus_identical": "SELECT count(*) AS left_records, count(*) AS right_records, count(*) FILTER (WHERE text = t) AS equal, "
                            "count(*) FILTER (WHERE text <> t) AS different, count(*) FILTER (WHERE text = t) = count(*) AS identical "
                            "FROM (SELECT text, rtrim(text, ' ' || chr(10)) AS t FROM documents)",
        "bootstrap_mean": T(PER_DOC + "SELECT round(avg(final_acc), 6) AS mean, count(*) AS docs, 10000 AS n_boot, true AS bracketed FROM pdr"),
        "requests": T(REQUESTS),
        # repair changes what is kept of unsupported optional fields, nothing else that the trace shows
        "field_trace": T("SELECT run, doc_id, field, round(score, 6) AS score, round(support, 6) AS support, flagged, "
                         "CASE WHEN run = 'repair' AND NOT req AND support < 0.5 THEN len(list_filter(gold_key, lambda x: x <> '')) = 0 ELSE final_ok END AS correct, "
                         "NOT req AS optional FROM tt, (SELECT unnest(['plain', 'repair']) AS run)").replace("SELECT run, doc_id", "SELECT run AS run_id, doc_id"),
        "cell_summary": "WITH plain AS (" + T(PER_DOC + REPORT) + "), repair AS (" + T(PER_DOC + REPORT, repair=True) + """),
            cells AS (SELECT * FROM (VALUES ('plain', 'tpch', false), ('repair', 'tpch', true)) AS c(run_id, corpus, repair)
              UNION ALL SELECT v.config || '-' || lower(r_name), lower(r_name), v.config = 'repair' FROM region, (VALUES ('plain'), ('repair')) v(config)),
            stored AS (SELECT 'plain' AS run, * EXCLUDE (run_id) FROM plain UNION ALL SELECT 'repair', * EXCLUDE (run_id) FROM repair)
            SELECT run_id, corpus, repair, docs, final_acc, constrained_acc, calls_saved, llm_calls, low_confidence, flag_precision, flag_recall,
              flag_precision_micro, flag_recall_micro, ungrounded_rate FROM cells LEFT JOIN stored ON run = run_id""",
        "missing_cells": "SELECT v.config || '-' || lower(r_name) AS run_id, lower(r_name) AS corpus, v.config = 'repair' AS repair FROM region, (VALUES ('plain'), ('repair')) v(config)",
        "stored_sweep": T(SWEEP),
        "corpus_order": "SELECT row_number() OVER (ORDER BY k DESC, doc_id) - 1 AS doc_idx, sha256(text) AS document_sha, CAST(k AS VARCHAR) AS k "
                        "FROM (SELECT *, CAST(floor(sqrt(doc_id)) AS BIGINT) AS k FROM documents)",
        "corpus_catalog": "SELECT lang AS corpus, true AS present, count(*) OVER (PARTITION BY lang) AS records, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS doc_idx, "
                          "sha256(text) AS document_sha FROM documents WHERE lang IS NOT NULL QUALIFY doc_idx < 6 UNION ALL SELECT 'absent', false, 0, NULL, NULL",
        "contracts": r"""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_idx,
              sha256(replace(replace(replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n', chr(10)), '\t', chr(9)), '\r', '')) AS document_sha,
              n_chars || ' chars' AS term, '' AS jurisdiction, CASE WHEN doc_id % 5 <> 0 THEN 'A ' || doc_id || '; B' ELSE '' END AS party FROM documents""",
        "receipts": """SELECT printf('%05d receipt', s_suppkey) AS stem, s_name || chr(10) || 'TOTAL, RM ' || printf('%.2f', s_acctbal) || chr(10) AS document, s_name AS company,
              '2020-01-05' AS date, 'No. ' || s_suppkey AS address, printf('%.2f', s_acctbal) AS total FROM supplier WHERE s_suppkey % 7 <> 3 AND s_suppkey % 11 <> 4 AND s_suppkey % 13 <> 5""",
        "gold_keys": "SELECT count(*) AS records, count(*) AS non_blank, count(*) FILTER (WHERE o_orderkey % 59 = 3) AS lacking, "
                     "count(*) FILTER (WHERE o_orderkey % 59 <> 3 AND o_orderkey % 61 = 4) AS adding, count(*) FILTER (WHERE o_orderkey % 59 = 3 OR o_orderkey % 61 = 4) = 0 AS exact FROM orders",
        "acquired_cost": T(PER_DOC + """SELECT run_id, 2 * (SELECT count(*) FILTER (WHERE NOT noresp) FROM bt) + (SELECT count(*) FROM tt WHERE flagged AND NOT noarb) AS llm_calls,
            final_acc, low_confidence FROM (""" + REPORT + ")"),
        "stage_payloads": T(_payloads()),
        "events_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS con_num FROM events",
        "stage_events": T("""SELECT stage, n, first_seq, last_seq FROM (
            SELECT unnest(['source','constrained','unconstrained','normalize','disagree','arbiter_done','ground','kept']) AS stage,
                   (SELECT count(DISTINCT doc_id) FROM tt) AS n, unnest([0, 1, 2, 3, 4, 12, 13, 14]) AS first_seq, unnest([0, 1, 2, 3, 4, 12, 13, 14]) AS last_seq
            UNION ALL SELECT 'arbiter_field', count(*), 5 + min(ord), 5 + max(ord) FROM tt WHERE flagged)"""),
        "ungrounded_monitor": T("""SELECT CAST(time_bucket(INTERVAL 30 DAY, CAST(od AS TIMESTAMP), TIMESTAMP '1970-01-01') AS DATE) AS window_start,
            count(*) AS fields, count(*) FILTER (WHERE ungrounded) AS ungrounded,
            round(count(*) FILTER (WHERE ungrounded) / count(*), 6) AS rate FROM tt GROUP BY 1"""),
    }
    return q
