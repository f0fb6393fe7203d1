"""DuckDB SQL for the queries that it can express, with the same parameters."""

from __future__ import annotations

from ranktide.llm import chat, lm, merkle, neardup, quality, sharding, substring
from ranktide.llm.decontam import SHINGLE, THRESHOLD

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _words(text: str) -> str:
    return WORDS.format(f"coalesce({text}, '')")


def op1() -> str:
    rules = quality.Rules()
    edges = quality.EDGES.replace("'", "''")
    punctuation = quality.PUNCTUATION.replace("'", "''").replace("-", r"\-")
    kinds = ["a-z", "A-Z", "0-9", r"\x20\x09-\x0D", punctuation]
    counts = [rf"length(regexp_replace(t, '[^{k}]', '', 'g'))" for k in kinds]
    other = rf"length(regexp_replace(t, '[^\x00-\x7f]', '', 'g')) - {' - '.join(counts)}"
    beyond = r"length(regexp_replace(t, '[\x00-\x7f]', '', 'g'))"
    js = ("sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END"
          " + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, lang, t, {WORDS.format('t')} AS ws FROM d),
u AS (SELECT r, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
often AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
rep AS (SELECT r, count(DISTINCT i + o.o) AS n FROM often, (SELECT unnest([0, 1, 2]) AS o) o GROUP BY r),
ln AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
b AS (SELECT w.r, doc_id, lang, t, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words
      FROM w JOIN ln USING (r) LEFT JOIN rep USING (r)),
cc AS (SELECT r, lang, unnest(range(7)) AS bin, unnest([{', '.join(counts)}, {other}, {beyond}]) AS n FROM d),
cq AS (SELECT lang, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cc GROUP BY lang, bin),
cp AS (SELECT r, lang, bin, n / nullif(sum(n) OVER (PARTITION BY r), 0) AS p FROM cc),
cd AS (SELECT r, {js} AS class_distance FROM cp JOIN cq USING (lang, bin)
       WHERE r IN (SELECT r FROM d WHERE length(t) >= {rules.min_class_chars}) GROUP BY r),
nw AS (SELECT r, lang, lower(trim(w, '{edges}')) AS k, count(*) AS n FROM u GROUP BY ALL),
lw AS (SELECT lang, k, sum(n) AS n FROM nw GROUP BY ALL),
com AS (SELECT lang, k, n FROM lw WHERE k <> ''
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, k) <= {rules.common}),
wq AS (SELECT lang, k, n FROM com UNION ALL
       SELECT lang, NULL, (SELECT sum(n) FROM lw WHERE lw.lang = com.lang) - sum(n) FROM com GROUP BY lang),
wqs AS (SELECT lang, k, n / sum(n) OVER (PARTITION BY lang) AS q FROM wq),
own AS (SELECT nw.r, com.k, sum(nw.n) AS n FROM nw LEFT JOIN com ON com.lang = nw.lang AND com.k = nw.k GROUP BY ALL),
wd AS (SELECT r, {js} AS word_distance
       FROM (SELECT b.r, wqs.q, coalesce(own.n, 0) / b.n_words AS p FROM b JOIN wqs USING (lang)
             LEFT JOIN own ON own.r = b.r AND own.k IS NOT DISTINCT FROM wqs.k WHERE n_words >= {rules.min_words}) GROUP BY r),
f AS (SELECT *, n_words < {rules.base_min_words} OR 100 * n_repeat_words > {rules.base_max_repeat_percent} * n_words AS base_failed
      FROM b LEFT JOIN cd USING (r) LEFT JOIN wd USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(class_distance, 0) <= {rules.max_class_distance}
         AND coalesce(word_distance, 0) <= {rules.max_word_distance} AS kept,
       round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
FROM f"""


def op2() -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS k
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM w WHERE len(ws) > 0)
      UNION ALL SELECT doc_id, '' FROM w WHERE len(ws) = 0),
e AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id, k) AS o FROM s),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.k = b.k AND a.o = b.o AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= ({neardup.THRESHOLD} - 1e-9) * (x.n + y.n - c)),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(least(doc_id, b), doc_id) AS class_id FROM documents LEFT JOIN low ON low.a = doc_id"""


def op3() -> str:
    def grams(table: str, key: str) -> str:
        return (f"SELECT DISTINCT {key}, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS k FROM (SELECT {key}, ws, "
                f"unnest(range(1, len(ws) - {SHINGLE - 2})) AS i FROM (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), "
                f"'(?:[0-9a-z]|[^\\x00-\\x7f])+') AS ws FROM {table}) WHERE len(ws) >= {SHINGLE})")

    return f"""
WITH d AS ({grams('documents', 'doc_id')}), i AS ({grams('benchmark', 'item_id')}),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) / n AS containment, n::INT AS n_shingles
FROM d JOIN i USING (k) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= {THRESHOLD} * n"""


def op4() -> str:
    v = lm.VOCABULARY

    def loss(name: str) -> str:
        return (f"-ln((coalesce({name}.n, 0) + {lm.PULL} * {name}a.p) / (coalesce({name}b.n, 0) + {lm.PULL}))")

    def model(name: str, where: str) -> str:
        return f"""
{name} AS (SELECT prev, id, count(*) AS n FROM k {where} GROUP BY ALL),
{name}b AS (SELECT prev, sum(n) AS n FROM {name} GROUP BY prev),
{name}o AS (SELECT id, sum(n) AS n FROM {name} GROUP BY id),
{name}a AS (SELECT id, (coalesce(n, 0) + 1) / ((SELECT coalesce(sum(n), 0) FROM {name}o) + (SELECT count(*) FROM ids)) AS p
            FROM ids LEFT JOIN {name}o USING (id)),"""

    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
u AS (SELECT r, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
voc AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) - 1 AS id FROM u GROUP BY w QUALIFY id < {v}),
ids AS (SELECT id FROM voc UNION ALL SELECT {v}),
x AS (SELECT r, doc_id, i, coalesce(id, {v}) AS id FROM u LEFT JOIN voc USING (w)),
k AS (SELECT r, doc_id, id, coalesce(lag(id) OVER (PARTITION BY r ORDER BY i), -1) AS prev FROM x),
{model('tg', 'WHERE doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING bool_or(quality = 1) AND NOT coalesce(bool_or(toxic = 1), FALSE))')}
{model('bg', '')}
s AS (SELECT r, count(*) AS n, avg({loss('tg')}) AS tl, avg({loss('bg')}) AS bl
      FROM k LEFT JOIN tg USING (prev, id) LEFT JOIN tgb USING (prev) JOIN tga USING (id)
             LEFT JOIN bg USING (prev, id) LEFT JOIN bgb USING (prev) JOIN bga USING (id) GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_tokens, round(tl, 6) AS target_loss, round(bl, 6) AS background_loss,
       round(tl - bl, 6) AS difference FROM t LEFT JOIN s USING (r)"""


def op6() -> str:
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT *, list_transform(string_split(sha1(h), ''), lambda c: instr('0123456789abcdef', c) - 1) AS v,
             min(page_id) OVER (PARTITION BY h) AS f FROM p),
y AS (SELECT *, list_transform(range(160), lambda i: (v[i // 4 + 1] >> (3 - i % 4)) & 1) AS b FROM x)
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (16 * b[5 * j + 1] + 8 * b[5 * j + 2] + 4 * b[5 * j + 3] + 2 * b[5 * j + 4] + b[5 * j + 5] + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM y"""


def _tree(shards: int, name: str) -> str:
    """The shard of ``key`` by the tree, as nested CASEs over draws."""
    tree = sharding.even_tree(shards)
    weight: dict[str, float] = {}
    for s in tree:
        for path in (f"/r{s.region}", f"/r{s.region}/k{s.rack}", f"/r{s.region}/k{s.rack}/s{s.shard}"):
            weight[path] = weight.get(path, 0) + s.weight

    def draw(path: str) -> str:
        return (f"-ln((CAST('0x' || substr(md5(key || '{path}'), 1, 13) AS BIGINT)::DOUBLE + 1) / {2**52 + 1}.0)"
                f" / {weight[path]}")

    def pick(children: dict[str, str]) -> str:
        if len(children) == 1:
            return next(iter(children.values()))
        low = f"least({', '.join(draw(p) for p in children)})"
        return "CASE " + " ".join(f"WHEN {draw(p)} = {low} THEN {v}" for p, v in children.items()) + " END"

    racks: dict[str, dict[str, str]] = {}
    for s in tree:
        racks.setdefault(f"/r{s.region}/k{s.rack}", {})[f"/r{s.region}/k{s.rack}/s{s.shard}"] = str(s.shard)
    regions: dict[str, dict[str, str]] = {}
    for rack, leaves in racks.items():
        regions.setdefault(rack.rsplit("/", 1)[0], {})[rack] = f"({pick(leaves)})"
    return f"({pick({r: f'({pick(k)})' for r, k in regions.items()})}) AS {name}"


def op7(shards: int) -> str:
    return f"""
WITH crc AS (SELECT list_transform(range(16), lambda i: list_reduce(range(4), lambda c, k:
       CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, octet_length(encode(coalesce(text, ''))) + 16 AS size,
      hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT d.*, list_transform(string_split(regexp_replace(h, '(.)(.)', '\\2\\1', 'g'), ''),
      lambda c: instr('0123456789ABCDEF', c) - 1) AS v FROM d),
s AS (SELECT doc_id, key, size::BIGINT AS size, CASE WHEN size = 16 THEN 0 ELSE xor(list_reduce(v, lambda c, b:
        xor(c >> 4, crc.t[(xor(c, b) & 15) + 1]), 4294967295), 4294967295) END AS text_crc32,
        {_tree(shards, 'shard')}, {_tree(shards + 1, 'grown_shard')}
      FROM n, crc)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % {sharding.BUCKETS},
                          doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard::INT AS grown_shard
FROM s"""


def op8(extra: str) -> str:
    names = "CASE " + " ".join(f"WHEN role = '{r}' THEN '### {n}:'" for r, n in chat.NAMES.items()) \
        + " ELSE '### Role ' || url_encode(role) || ':' END"
    control = chat.HEADER + "|" + chat.CLOSE
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{extra}' UNION ALL SELECT -7, 1, 'assistant', '{extra}'),
r AS (SELECT *, {names} || chr(10) || regexp_replace(text, '(\\\\*)({control})', '\\1\\1\\\\\\2', 'g') || chr(10)
        || '{chat.CLOSE}' || chr(10) AS rendered FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, rendered)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, rendered) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(rendered))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id"""


def op10() -> str:
    w = substring.WIDTH
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS ws FROM documents),
p AS (SELECT r, doc_id, i, md5(array_to_string(ws[i:i + {w - 1}], ' ')) AS k
      FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - {w - 2})) AS i FROM d WHERE len(ws) >= {w})),
late AS (SELECT r, i FROM p QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id),
gone AS (SELECT DISTINCT r, i + o AS i FROM late, (SELECT unnest(range({w})) AS o)),
u AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
k AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM u ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""


def op11() -> str:
    def field(column: str) -> str:
        return f"coalesce(octet_length(encode({column}::VARCHAR))::VARCHAR || ':' || {column}::VARCHAR, '-')"

    def leaf(n_chars: str) -> str:
        return f"sha256({' || '.join(field(n_chars if c == 'n_chars' else c) for c in merkle.COLUMNS)})"

    up = "list_transform(range(0, len(l), 2), lambda i: sha256(l[i + 1] || coalesce(l[i + 2], '')))"
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(16), lambda i: list_reduce(range(4), lambda c, k:
       CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
v AS (SELECT *, {leaf('n_chars')} AS leaf, xor(list_reduce(list_transform(string_split(regexp_replace(hex(encode(doc_id::VARCHAR)),
        '(.)(.)', '\\2\\1', 'g'), ''), lambda c: instr('0123456789ABCDEF', c) - 1),
        lambda c, b: xor(c >> 4, crc.t[(xor(c, b) & 15) + 1]), 4294967295), 4294967295) AS c FROM documents, crc),
d AS (SELECT doc_id, lang, leaf, CASE WHEN c % {merkle.TAMPER} = 0 THEN {leaf('(n_chars + 1)')} ELSE leaf END AS found,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM v),
t AS (SELECT lang, 0 AS k, list(leaf ORDER BY pos) AS l FROM d GROUP BY lang
      UNION ALL SELECT lang, k + 1, {up} FROM t WHERE len(l) > 1),
s AS (SELECT lang, l[1] AS subroot, k AS height, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS nth FROM t WHERE len(l) = 1),
o AS (SELECT 0 AS k, list(subroot ORDER BY nth) AS l FROM s UNION ALL SELECT k + 1, {up} FROM o WHERE len(l) > 1),
p AS (SELECT row_number() OVER () AS r, d.*, subroot, height, nth FROM d JOIN s ON d.lang IS NOT DISTINCT FROM s.lang),
w AS (SELECT r, k, (pos >> k) % 2 AS odd, t.l[xor(pos >> k, 1) + 1] AS other FROM p JOIN t ON t.lang IS NOT DISTINCT FROM p.lang AND len(t.l) > 1
      UNION ALL SELECT r, height + k, (nth >> k) % 2, o.l[xor(nth >> k, 1) + 1] FROM p JOIN o ON len(o.l) > 1),
f AS (SELECT r, 0 AS k, found AS node FROM p
      UNION ALL SELECT r, f.k + 1, sha256(CASE WHEN odd = 1 THEN other || node ELSE node || coalesce(other, '') END) FROM f JOIN w USING (r, k)),
g AS (SELECT r, arg_max(node, k) AS folded_root FROM f GROUP BY r),
q AS (SELECT r, sha256(string_agg(coalesce(other, ''), '' ORDER BY k)) AS proof_sha256 FROM w GROUP BY r)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN g USING (r) LEFT JOIN q USING (r), (SELECT l[1] AS root FROM o WHERE len(l) = 1)"""
