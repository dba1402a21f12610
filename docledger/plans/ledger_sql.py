"""SQL of the ledger views, for the reference queries: written from the tables, independent of any text."""

# One row per line: exact decimals.
LI = """li AS (SELECT l_orderkey AS doc_id, l_linenumber, l_suppkey, l_returnflag, l_linestatus, l_partkey,
  'Part ' || l_partkey || ' stock' AS description,
  CAST(l_quantity AS DECIMAL(9,2)) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_price,
  CAST(l_tax AS DECIMAL(4,2)) AS rate,
  CAST(round(CAST(l_quantity AS DECIMAL(9,2)) * CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS amount
  FROM lineitem),
it AS (SELECT *, CAST(round(amount * rate, 2) AS DECIMAL(18,2)) AS tax_amount FROM li)"""

# One row per order, with the parties and totals of its invoice.
INV = f"""{LI},
tot AS (SELECT doc_id, count(*) AS n_items, sum(amount) AS subtotal, sum(tax_amount) AS tax_amount, min(l_suppkey) AS sk FROM it GROUP BY doc_id),
inv AS (SELECT o_orderkey AS doc_id, 'INV-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS document_number,
  CAST(o_orderdate AS DATE) AS issue_date, o_orderpriority AS prio, o_orderstatus AS status,
  CASE o_orderpriority WHEN '2-HIGH' THEN 14 WHEN '3-MEDIUM' THEN 30 END AS days,
  CASE o_orderpriority WHEN '1-URGENT' THEN CAST(o_orderdate AS DATE) + 7 WHEN '5-LOW' THEN CAST(o_orderdate AS DATE) + 400
    WHEN '2-HIGH' THEN CAST(o_orderdate AS DATE) + 14 WHEN '3-MEDIUM' THEN CAST(o_orderdate AS DATE) + 30 END AS due_date,
  CASE coalesce(c_nationkey, 0) % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'es' WHEN 3 THEN 'fr' ELSE 'pl' END AS lang,
  CASE coalesce(c_nationkey, 0) % 5 WHEN 0 THEN 'USD' WHEN 4 THEN 'PLN' ELSE 'EUR' END AS currency,
  s_name AS seller_name, CASE WHEN s_name IS NOT NULL THEN 'SU' || lpad(CAST(sk AS VARCHAR), 8, '0') END AS seller_tax_id,
  CASE WHEN s_name IS NOT NULL THEN 's' || sk || '@example.com' END AS seller_email, ns.n_name AS seller_address,
  c_name AS buyer_name, CASE WHEN c_mktsegment <> 'FURNITURE' THEN lpad(CAST(o_custkey AS VARCHAR), 10, '0') END AS buyer_tax_id,
  CASE WHEN c_name IS NOT NULL THEN 'c' || o_custkey || CASE WHEN c_mktsegment = 'MACHINERY' THEN '@invalid' ELSE '@example.com' END END AS buyer_email,
  nc.n_name AS buyer_address, CASE WHEN c_name IS NOT NULL THEN '+49 30 ' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') END AS buyer_phone,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'DE' || lpad(CAST(o_custkey AS VARCHAR), 20, '0') END AS account,
  CASE o_orderstatus WHEN 'O' THEN 'Bank Transfer' WHEN 'F' THEN 'Credit Card' END AS method,
  coalesce(n_items, 0) AS n_items, subtotal, tax_amount, CASE WHEN o_orderpriority = '1-URGENT' THEN 5 END AS tax_rate,
  CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE subtotal + tax_amount END AS total
  FROM orders LEFT JOIN tot ON tot.doc_id = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN supplier ON s_suppkey = sk LEFT JOIN nation ns ON ns.n_nationkey = s_nationkey LEFT JOIN nation nc ON nc.n_nationkey = c_nationkey)"""

# The same invoices, all written in English.
INV_EN = INV.replace(
    "CASE coalesce(c_nationkey, 0) % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'es' WHEN 3 THEN 'fr' ELSE 'pl' END AS lang", "'en' AS lang"
).replace("CASE coalesce(c_nationkey, 0) % 5 WHEN 0 THEN 'USD' WHEN 4 THEN 'PLN' ELSE 'EUR' END AS currency", "'USD' AS currency")


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def text(expr: str) -> str:
    """Text with '' for missing."""
    return f"coalesce(CAST({expr} AS VARCHAR), '')"
