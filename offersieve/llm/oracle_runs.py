"""DuckDB SQL of op11_periodic_runs, by pairs of equal words up to a third of the text apart, joined up into stretches; and of
op13_fingerprints."""

#: crc32 by its table of 256 remainders, made from the polynomial.
_CRC = """z AS (SELECT list(v ORDER BY k) AS tab FROM (SELECT k, list_reduce(list_prepend(k::UBIGINT, list_transform(range(8), lambda x: x::UBIGINT)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS k)))"""

OP11 = rf"""WITH {_CRC},
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT rid, doc_id, w, len(w) AS n, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)), lambda c, b: xor(c >> 8, tab[((xor(c, b) & 255) + 1)::BIGINT])))::BIGINT AS h FROM d, z),
g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, h // 10 AS g FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
v AS (SELECT rid, n, i, CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS w FROM (SELECT *, unnest(range(n)) AS i FROM p)),
e AS (SELECT x.rid, x.i, y.i - x.i AS q FROM v x JOIN v y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND y.i <= x.i + x.n // 3),
s AS (SELECT rid, min(i) AS s, count(*) + q AS l, q FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS isle FROM e) GROUP BY rid, q, isle HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT rid, s, l, min(q) AS q FROM s GROUP BY rid, s, l),
b AS (SELECT rid, s, l, q FROM r QUALIFY row_number() OVER (PARTITION BY rid ORDER BY l / q DESC, s, q) = 1),
t AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS told FROM r GROUP BY rid),
k AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS kept FROM v ANTI JOIN (SELECT DISTINCT rid, unnest(range(s + q, s + l)) AS i FROM r) USING (rid, i) GROUP BY rid)
SELECT doc_id::BIGINT AS doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (rid) LEFT JOIN t USING (rid) LEFT JOIN k USING (rid)"""

_LOW = "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SKETCH = "list_sort(list_distinct(list_transform(list_filter(list_transform(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END, lambda s: md5(s)), lambda h: h < '2'), lambda h: h[1:12])))"


def _prints(table: str, text: str) -> str:
    return rf"SELECT *, substr(md5(low), 1, 16) || ':' || array_to_string(s, ',') AS p FROM (SELECT *, {_SKETCH} AS s FROM (SELECT *, regexp_extract_all(low, '[^\x20\x09-\x0D]+') AS w FROM (SELECT *, {_LOW.replace('x,', text + ',')} AS low FROM {table})))"


_NEAR = "CASE WHEN len({a}) + len({b}) = 0 THEN CASE WHEN substr({p}, 1, 16) = substr({q}, 1, 16) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"

OP13 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS ({_prints('d', 't')}),
n AS (SELECT doc_id, t, s, p, length(t) AS n, coalesce(lead(t) OVER v, first_value(t) OVER v) AS nt, coalesce(lead(s) OVER v, first_value(s) OVER v) AS ns, coalesce(lead(p) OVER v, first_value(p) OVER v) AS np FROM o WINDOW v AS (ORDER BY doc_id)),
e AS (SELECT doc_id, n, s AS os, p AS op, ns, np, left(t, n - n // 2) || left(nt, n // 2) AS e FROM n),
x AS ({_prints('e', 'e')})
SELECT doc_id::BIGINT AS doc_id, n::BIGINT AS n_chars, sha256(e) AS edited_sha256, op AS fingerprint, p AS edited_fingerprint, {_NEAR.format(a='os', b='s', p='op', q='p')} AS near_edited, {_NEAR.format(a='os', b='ns', p='op', q='np')} AS near_next
FROM x"""
