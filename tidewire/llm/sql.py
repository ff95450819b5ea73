"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP2 = f"""WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_words('text')} AS w FROM benchmark),
  lengths AS (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
  windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS t FROM (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM lengths)),
  docs AS (SELECT doc_id, {_words('text')} AS w FROM documents),
  spots AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM docs CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
  found AS (SELECT doc_id, i, s.n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS t FROM spots) s JOIN windows x ON s.t = x.t AND s.n = x.n),
  hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
  listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM docs d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN listed l ON d.doc_id = l.doc_id"""

OP8 = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS hex FROM pages),
  b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(hex, i, 1))]), '') AS bits FROM p),
  d AS (SELECT page_id, size, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: CASE WHEN substr(bits, i * 5 + j + 1, 1) = '1' THEN CAST(pow(2, 4 - j) AS BIGINT) ELSE 0 END))::BIGINT, 1)), '') AS digest FROM b),
  m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS best FROM d)
  SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM m"""

OP6 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END AS l FROM d WHERE len(w) > 0), unnest(l) AS u(sh)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
  e AS (SELECT x, y FROM i JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * k >= 80 * (p.n + q.n - k)),
  sym AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
  walk(doc, node) AS (SELECT x, x FROM sym UNION SELECT w.doc, sym.y FROM walk w JOIN sym ON w.node = sym.x),
  c AS (SELECT doc, min(node) AS component FROM walk GROUP BY doc)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, coalesce(c.component, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.doc"""
