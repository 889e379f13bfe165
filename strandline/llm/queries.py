"""The queries op1_ ... op13_, each the whole of its table through its operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, chat_format, divergence, exact_dedup, jaccard_join, license_scan, packing, pii, quality_rules, spelling, topk_search, toxicity, url_filter
from strandline.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk_search.quantised(F.col("embedding")).alias("v"))
    return topk_search.exact_topk(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_sql() -> str:
    """The steps in RE2, then one step for each rule."""
    def quote(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def table(entries: dict[str, str]) -> str:
        return f"MAP([{', '.join(map(quote, entries))}], [{', '.join(map(quote, entries.values()))}])"

    known, tag = license_scan.known_sentences(), license_scan.TAG
    text = "coalesce(text, '')"
    for pattern, sign in license_scan.STEPS:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(sign.replace('$1', chr(92) + '1'))}, 'g')"
    found = f"list_transform(regexp_extract_all(lower({text}), {quote(license_scan.wanted(known))}), lambda s: regexp_replace(s, '[ \\x01]+', ' ', 'g'))"
    own = f"list_transform(regexp_extract_all(substr(s, {len(tag)}), {quote(license_scan.in_tag(known))}), lambda x: {table(license_scan.tagged(known))}[x])"
    rules = license_scan.expanded_rules()
    steps = [f"r{i + 1} AS (SELECT rid, CASE WHEN contains(l, {quote(seq)}) THEN replace(l, {quote(seq)}, '#') ELSE l END AS l, CASE WHEN contains(l, {quote(seq)}) THEN list_append(f, {quote(lic)}) ELSE f END AS f FROM r{i})" for i, (lic, seq) in enumerate(rules)]
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, flatten(list_transform({found}, lambda s: CASE WHEN starts_with(s, {quote(tag)}) THEN {own} ELSE [{table(known)}[s]] END)) AS ids FROM documents),
r0 AS (SELECT rid, ';' || array_to_string(ids, ';;') || ';' AS l, CAST([] AS VARCHAR[]) AS f FROM d WHERE len(ids) > 0),
{", ".join(chr(10) + s for s in steps)},
firsts AS (SELECT rid, list_filter(f, lambda x, j: list_position(f, x) = j) AS found FROM r{len(rules)})
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ';') AS sentence_ids, coalesce(array_to_string(found, ';'), '') AS licenses, CAST(coalesce(len(found), 0) AS BIGINT) AS n_licenses FROM d LEFT JOIN firsts USING (rid)"""


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


#: Levels that the SQL of op3 goes down; the tables' paths have three segments at most, and the query itself goes as deep as they do.
SQL_LEVELS = 8


def op3_sql() -> str:
    """Split, rules and generalised segments, then one set of steps for each level of the tree."""
    o = url_filter.TreeOptions()
    m, z = f"{o.smoothing!r}::DOUBLE", f"{o.z!r}::DOUBLE"

    def fits(rule: str) -> str:
        name, slash, tail = rule.partition("/")
        return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{tail}')"

    longest = sorted(url_filter.RULES, key=lambda r: -len(r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in longest) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in longest) + " END"
    stem, end = "regexp_extract(s, '^(.*?)(\\.[A-Za-z]{1,5})?$', 1)", "regexp_extract(s, '(\\.[A-Za-z]{1,5})?$')"
    kind = f"""CASE WHEN regexp_matches({stem}, '^[0-9]+$') THEN '{{n}}' || {end} WHEN regexp_matches({stem}, '^[0-9a-fA-F]{{8,}}$') OR regexp_matches({stem}, '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$') THEN '{{hex}}' || {end}
    WHEN regexp_matches({stem}, '[0-9]') THEN '{{x}}' || {end} ELSE s END"""
    steps = [
        "p0 AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"p1 AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p0)",
        f"p2 AS (SELECT *, {rule} AS rule, {ruled} AS ruled, list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM p1)",
        f"p3 AS (SELECT *, list_transform(parts, lambda s: {kind}) AS segs FROM p2)",
        "counts AS (SELECT host, segs, count(*) AS n, count(ruled) AS l, count(*) FILTER (ruled = 'block') AS b FROM p3 GROUP BY host, segs)",
        "root AS (SELECT (sum(b) + 1.0::DOUBLE) / (sum(l) + 2.0::DOUBLE) AS r FROM counts)",
        f"hosts AS (SELECT host, (sum(b) + {m} * any_value(r)) / (sum(l) + {m}) AS share, sum(l) > 0 AS open FROM counts, root GROUP BY host)",
        "at0 AS (SELECT host, segs, n, l, b, '' AS node, share, open FROM counts JOIN hosts USING (host))",
    ]
    # a run's state and each entry are of one type: counts, the run's number, and the numbers given so far
    pooled = "((x.b + y.b + 1.0::DOUBLE) / (x.l + y.l + 2.0::DOUBLE))"
    apart = f"abs(CAST(y.b AS DOUBLE) / y.l - CAST(x.b AS DOUBLE) / x.l) > {z} * sqrt({pooled} * (1.0::DOUBLE - {pooled}) * (1.0::DOUBLE / y.l + 1.0::DOUBLE / x.l))"
    fold = f"list_reduce(list({{'l': l, 'b': b, 'run': 0, 'told': [{{'bin': bin, 'run': 0}}]}} ORDER BY bin), lambda x, y: CASE WHEN {apart} THEN {{'l': y.l, 'b': y.b, 'run': x.run + 1, 'told': list_append(x.told, {{'bin': y.told[1].bin, 'run': x.run + 1}})}} ELSE {{'l': x.l + y.l, 'b': x.b + y.b, 'run': x.run, 'told': list_append(x.told, {{'bin': y.told[1].bin, 'run': x.run}})}} END).told"
    for k in range(SQL_LEVELS):
        steps += [
            f"ch{k} AS (SELECT host, node, segs[{k + 1}] AS seg, CAST(sum(n) AS BIGINT) AS n, CAST(sum(l) AS BIGINT) AS l, CAST(sum(b) AS BIGINT) AS b, max(share) AS parent FROM at{k} WHERE open AND len(segs) > {k} GROUP BY 1, 2, 3)",
            f"kn{k} AS (SELECT *, b * {o.bins} // l AS bin FROM ch{k} WHERE l > 0)",
            f"bn{k} AS (SELECT host, node, bin, CAST(sum(l) AS BIGINT) AS l, CAST(sum(b) AS BIGINT) AS b, min(seg) AS first, count(*) AS many, max(parent) AS parent FROM kn{k} GROUP BY 1, 2, 3)",
            f"rn{k} AS (SELECT host, node, t.bin, t.run FROM (SELECT host, node, unnest({fold}) AS t FROM bn{k} GROUP BY host, node))",
            f"mg{k} AS (SELECT host, node, run, CASE WHEN sum(many) > 1 THEN min(first) || '|+' || (sum(many) - 1) ELSE min(first) END AS name, (sum(b) + {m} * max(parent)) / (sum(l) + {m}) AS share FROM bn{k} JOIN rn{k} USING (host, node, bin) GROUP BY 1, 2, 3)",
            f"st{k} AS (SELECT host, node, seg, name, share, true AS open FROM kn{k} JOIN rn{k} USING (host, node, bin) JOIN mg{k} USING (host, node, run) UNION ALL SELECT host, node, seg, CASE WHEN NOT starts_with(seg, '{{') AND n * {o.max_children} < of THEN '*' ELSE seg END, parent, false FROM (SELECT *, sum(n) OVER (PARTITION BY host, node) AS of FROM ch{k}) WHERE l = 0)",
            f"at{k + 1} AS (SELECT a.host, a.segs, a.n, a.l, a.b, a.node || '/' || s.name AS node, s.share, s.open FROM at{k} a JOIN st{k} s ON s.host = a.host AND s.node = a.node AND s.seg = a.segs[{k + 1}] WHERE a.open AND len(a.segs) > {k} UNION ALL SELECT host, segs, n, l, b, node, share, false FROM at{k} WHERE NOT (open AND len(segs) > {k}))",
        ]
    return "WITH " + ",\n".join(steps) + f"""
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN share > {o.worst!r}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN node = '' THEN '/' ELSE node END AS template, share AS blocked_share
FROM p3 JOIN at{SQL_LEVELS} USING (host, segs)"""


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op4_sql() -> str:
    """The patterns in their plain form, then the term test step by step."""
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
    found = " UNION ALL ".join(f"SELECT rid, {i} AS kind, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS g FROM d" for i, p in enumerate(plain.values()))
    word, o = pii.WORD, pii.Disclosure()
    names = "['email', 'ip', 'card', 'phone', 'term']"

    def least(hits: str, of: str) -> str:
        h, n, z, zz = f"CAST({hits} AS DOUBLE)", f"CAST({of} AS DOUBLE)", f"{o.z!r}::DOUBLE", f"{o.z * o.z!r}::DOUBLE"
        return f"({h} / {n} + {zz} / (2.0::DOUBLE * {n}) - {z} * sqrt({h} / {n} * (1.0::DOUBLE - {h} / {n}) / {n} + {zz} / (4.0::DOUBLE * {n} * {n}))) / (1.0::DOUBLE + {zz} / {n})"

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
u AS (SELECT rid, kind, unnest(m) AS v, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM f),
p AS (SELECT rid, kind, v, sum(length(gap) + length(v)) OVER (PARTITION BY rid, kind ORDER BY i) AS e, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM u),
b AS (SELECT rid, kind, v, CAST(e - length(v) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM p WHERE CASE kind
  WHEN 0 THEN true
  WHEN 1 THEN len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || left(ltrim(x, '0'), 3) AS INTEGER) > 255)) = 0
  WHEN 2 THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN (length(digits) - i) % 2 = 0 THEN CAST(digits[i] AS INTEGER) WHEN CAST(digits[i] AS INTEGER) > 4 THEN 2 * CAST(digits[i] AS INTEGER) - 9 ELSE 2 * CAST(digits[i] AS INTEGER) END)) % 10 = 0
  ELSE length(digits) BETWEEN 9 AND 15 END),
bo AS (SELECT *, coalesce(max(e) OVER (PARTITION BY rid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM b),
bm AS (SELECT rid, string_agg(substr(t, r + 1, greatest(s - r, 0)) || repeat(' ', greatest(e - greatest(s, r), 0)), '' ORDER BY s, e) || substr(any_value(t), max(e) + 1) AS t FROM bo JOIN d USING (rid) GROUP BY rid),
m AS (SELECT rid, coalesce(bm.t, d.t) AS t FROM d LEFT JOIN bm USING (rid)),
wl AS (SELECT rid, regexp_extract_all(t, '{word}') AS x, regexp_split_to_array(t, '{word}') AS g FROM m),
wu AS (SELECT rid, unnest(x) AS x, unnest(g[1:len(x)]) AS gap, generate_subscripts(x, 1) AS i FROM wl),
wp AS (SELECT rid, lower(x) AS term, CAST(z - length(x) AS BIGINT) AS s, CAST(z AS BIGINT) AS e FROM (SELECT *, sum(length(gap) + length(x)) OVER (PARTITION BY rid ORDER BY i) AS z FROM wu) WHERE length(lower(x)) >= {pii.LEAST_LETTERS}),
near AS (SELECT DISTINCT wp.rid, b.kind, lower(b.v) AS c, wp.term, wp.s FROM b JOIN wp USING (rid) WHERE wp.s >= b.s - {pii.WINDOW} AND wp.e <= b.e + {pii.WINDOW}),
most AS (SELECT term, max({{'d': d, 'n': n}}) AS c FROM (SELECT kind, c, term, count(DISTINCT rid) AS d, count(*) AS n FROM near GROUP BY kind, c, term) GROUP BY term),
nt AS (SELECT term, count(*) AS n_t, count(DISTINCT rid) AS d_t FROM wp GROUP BY term),
sh AS (SELECT term, {least('c.n', 'n_t')} AS by_n, {least('c.d', 'd_t')} AS by_d FROM most JOIN nt USING (term)),
told AS (SELECT term FROM sh WHERE least(by_n, by_d) >= {2.0**-o.generalise_bits!r}::DOUBLE),
ts AS (SELECT rid, s, e FROM wp JOIN told USING (term)),
spans AS (SELECT rid, kind, s, e FROM b UNION ALL SELECT rid, 4, s, e FROM ts),
told_of AS (SELECT rid, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) FILTER (kind = 3) AS n3, count(*) FILTER (kind = 4) AS n4,
  string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY kind, s) FILTER (kind < 4) AS base, string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY kind, s) AS every FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_email, coalesce(n1, 0) AS n_ip, coalesce(n2, 0) AS n_card, coalesce(n3, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(n4, 0) AS n_term, coalesce(every, '') AS spans
FROM d LEFT JOIN told_of USING (rid)"""


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, count(*) AS c, max(doc_id) AS k FROM n GROUP BY t)
SELECT doc_id, k AS keep_id, c AS group_size, doc_id = k AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)"""


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10ffff}]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS g FROM w),
x AS (SELECT DISTINCT doc_id, unnest(g) AS s FROM g),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM x a JOIN x b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE same >= 0.8::DOUBLE * (na.n + nb.n - same) - 1e-9::DOUBLE),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT a AS doc_id, min(b) AS low, count(*) AS size FROM r GROUP BY a),
m AS (SELECT a AS doc_id, count(*) AS links FROM l GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(low, doc_id)) AS class_id, coalesce(links, 0) AS n_links, coalesce(size, 1) AS class_size FROM documents LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)"""


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    read = chat_format.read_chats(chat_format.format_chats(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
esc AS (SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length(role) + length('<|turn|><|text|><|end|>') AS n FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(CAST(sum(CASE WHEN role = 'assistant' THEN length(text) END) AS BIGINT), 0) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(role, ',' ORDER BY turn), '(system,)?user,assistant(,user,assistant)*') AS valid
FROM esc GROUP BY conv_id"""


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, table(spark, sf_dir, "labels").filter(~held_out())))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (gn.total + 5 * v.v) AS p
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang JOIN gn ON gn.lang = g.lang AND gn.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (SELECT lang, CAST(sum(total) AS HUGEINT) AS total FROM gn GROUP BY lang),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (CAST(sum(n) AS HUGEINT) + 5)) // (any_value(total) + 5 * any_value(v)) AS q FROM c JOIN v USING (lang) JOIN whole USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, CAST(p.p - q.q AS BIGINT) AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50"""


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


#: The checksum is folded over the bytes with a table of 256 numbers, made by its rule; near words are found by keys and compared in pairs.
OP13_SQL = r"""
WITH RECURSIVE t AS (SELECT list(list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x) ORDER BY x) AS t FROM range(0, 256) r(x)),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM d)),
c AS (SELECT id, run, count(*) AS n FROM w WHERE length(run) >= 7 GROUP BY id, run),
b AS (SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END)) AS bytes FROM c),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM b, t),
s AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
x AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS wild, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM i),
l AS (SELECT DISTINCT word, n, less FROM x),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.wild = b.wild AND a.word <> b.word
  UNION ALL SELECT l.word, v.word, v.n FROM l JOIN v ON v.word = l.less UNION ALL SELECT v.word, l.word, l.n FROM l JOIN v ON v.word = l.less),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
r(word, root) AS (SELECT word, word FROM f WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM r JOIN f ON f.form = r.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r ON r.word = f.word"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pivot_topk, op2_license_scan, op3_url_filter, op4_pii, op5_toxicity, op6_exact_dedup, op7_byte_bpe, op8_packing, op9_jaccard_join, op10_chat_format, op11_quality_rules, op12_source_divergence, op13_spelling_groups)}


def oracle_sql() -> dict[str, str]:
    return {"op1_pivot_topk": OP1_SQL, "op2_license_scan": op2_sql(), "op3_url_filter": op3_sql(), "op4_pii": op4_sql(), "op6_exact_dedup": OP6_SQL, "op9_jaccard_join": OP9_SQL, "op10_chat_format": OP10_SQL, "op12_source_divergence": OP12_SQL, "op13_spelling_groups": OP13_SQL}
