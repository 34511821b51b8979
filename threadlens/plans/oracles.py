"""The SQL counterpart of every query that SQL can express, for DuckDB."""

from __future__ import annotations

from html.entities import name2codepoint

from threadlens.functions.vector import ADDEND, FACTOR, MODULUS, STEP
from threadlens.operators.multiprobe import PROBE_SHARE
from threadlens.operators.similarity import DEFAULT_K, DOCUMENT_BITS, WORD_BITS, hyperplanes
from threadlens.plans.queries import EMBEDDING_DIM, RECALL_SHARES, SAMPLE_SIZE
from threadlens.plans.views import view_sql

SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"


def with_views(names: str, body: str, extra: str = "", recursive: bool = False) -> str:
    """``body`` with the named views, then ``extra``, as common table expressions."""
    parts = [f"{name} AS ({view_sql(name)})" for name in names.split()]
    if extra:
        parts.append(extra)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"


# --- expressions ----------------------------------------------------------------------------------


def micro(x: str) -> str:
    return f"CAST(floor(({x})*1e6+0.5) AS BIGINT)"


def vec_text(v: str) -> str:
    return f"array_to_string(list_transform({v}, lambda x: CAST(floor(CAST(x AS DOUBLE)*1e6+0.5) AS BIGINT)), ',')"


def tokens(text: str, lower: bool = True) -> str:
    source = f"lower({text})" if lower else text
    return f"list_filter(string_split_regex({source}, '{SPACE}'), lambda w: w <> '')"


# The entities of HTML 4, a list of its own beside the one the job uses.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}


def plain_text(html: str) -> str:
    """HTML to text: the page is cut into a list of tokens, each becomes its text, entities go by the pieces between
    ampersands."""
    blank = r"[ \t\n\f\r]"
    value = f"""{blank}*=(?:{blank}*(?:"[^"]*(?:"|\\z)|''[^'']*(?:''|\\z)|[^ \\t\\n\\f\\r>"''][^ \\t\\n\\f\\r>]*|))"""
    inside = rf"(?:[ \t\n\f\r/]+|[^ \t\n\f\r/>][^ \t\n\f\r/>=]*(?:{value})?)*(?:>|\z)"
    tag = lambda name: rf"<{name}(?:[ \t\n\f\r/]{inside}|>)"
    whole = lambda name: rf"{tag(name)}.*?(?:{tag('/' + name)}|\z)"
    kinds = [r"<!---?>", r"<!--.*?(?:--!?>|\z)", *map(whole, ("script", "style", "title", "textarea")), rf"</?[a-z][^ \t\n\f\r/>]*{inside}",
             r"<[!?][^>]*(?:>|\z)", r"</[^a-z>][^>]*(?:>|\z)", "</>", "[^<]+", "<"]
    content = lambda name: f"regexp_extract(t, '(?is)^{tag(name)}(.*?)(?:{tag('/' + name)})?$', 1)"
    text = f"""CASE WHEN t = '<' OR t NOT LIKE '<%' THEN t
        WHEN regexp_matches(t, '(?i)^<p[ \\t\\n\\f\\r/>]') THEN chr(10)
        WHEN regexp_matches(t, '(?i)^<title[ \\t\\n\\f\\r/>]') THEN ' '||{content('title')}||' '
        WHEN regexp_matches(t, '(?i)^<textarea[ \\t\\n\\f\\r/>]') THEN ' '||{content('textarea')}||' '
        ELSE ' ' END"""
    t = f"""coalesce(array_to_string(list_transform(regexp_extract_all({html}, '(?is){"|".join(kinds)}'), lambda t: {text}), ''), '')"""
    t = f"CASE WHEN {html} IS NOT NULL THEN {t} END"
    code = ("coalesce(try_cast('0x'||regexp_extract(p,'^#[xX]0*([0-9a-fA-F]{1,6});',1) AS INT),"
            "try_cast(regexp_extract(p,'^#0*([0-9]{1,7});',1) AS INT))")
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    names = "MAP {" + ", ".join(f"{quoted(n)}: {quoted(c)}" for n, c in sorted(ENTITIES.items())) + "}"
    name = "regexp_extract(p,'^([a-zA-Z][a-zA-Z0-9]*);',1)"
    piece = f"""CASE WHEN i=1 THEN p
        WHEN {name} <> '' AND {names}[{name}] IS NOT NULL THEN {names}[{name}]||substr(p,length({name})+2)
        WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111
          THEN chr({code})||regexp_replace(p,'^#[xX]?[0-9a-fA-F]+;','')
        ELSE '&'||p END"""
    t = f"array_to_string(list_transform(string_split({t}, '&'), lambda p, i: {piece}), '')"
    t = f"regexp_replace({t}, '[ \\t\\r\\f\\x0B\\xA0]+', ' ', 'g')"
    t = f"regexp_replace({t}, ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({t}, '^[ \\n]+|[ \\n]+$', '', 'g')"


def fraction(use: str, key: str = "id", seed: int = 1) -> str:
    return f"CAST('0x'||substr(md5(concat_ws(':',{key},'{use}','{seed}')),1,8) AS BIGINT)/4294967296.0::DOUBLE"


def bucket(vec: str, bits: int) -> str:
    def bit(plane) -> str:
        literal = ",".join(repr(float(x)) for x in plane)
        return f"CASE WHEN list_dot_product({vec}, [{literal}]::DOUBLE[])>0 THEN '1' ELSE '0' END"

    return "||".join(bit(plane) for plane in hyperplanes(bits, EMBEDDING_DIM))


# --- shared parts ---------------------------------------------------------------------------------

TYPED = """SELECT CASE WHEN regexp_matches(author,'[^\\x00-\\x20]') THEN author END AS author,
  CASE WHEN regexp_matches(score,'{n}') THEN try_cast(trim(score) AS INT) END AS score,
  strftime(make_timestamp(CASE WHEN regexp_matches(time,'{n}') THEN try_cast(trim(time) AS BIGINT) END * 1000000),
           '%Y-%m-%d %H:%M:%S') AS timestamp,
  CASE WHEN regexp_matches(title,'[^\\x00-\\x20]') THEN title END AS title,
  CASE WHEN regexp_matches(type,'[^\\x00-\\x20]') THEN type END AS type,
  CASE WHEN regexp_matches(url,'[^\\x00-\\x20]') THEN url END AS url,
  CASE WHEN regexp_matches(text,'[^\\x00-\\x20]') THEN text END AS text,
  CASE WHEN regexp_matches(parent,'{n}') THEN try_cast(trim(parent) AS BIGINT) END AS parent,
  CASE lower(deleted) WHEN 'true' THEN true WHEN 'false' THEN false END AS deleted,
  CASE lower(dead) WHEN 'true' THEN true WHEN 'false' THEN false END AS dead,
  CASE WHEN regexp_matches(descendants,'{n}') THEN try_cast(trim(descendants) AS INT) END AS descendants,
  try_cast(trim(id) AS BIGINT) AS id,
  CASE WHEN regexp_matches(ranking,'{n}') THEN try_cast(trim(ranking) AS INT) END AS ranking
FROM raw_items WHERE regexp_matches(id,'{n}') AND try_cast(trim(id) AS BIGINT) IS NOT NULL""".replace(
    "{n}", "^[\\x00-\\x20]*[+-]?[0-9]+[\\x00-\\x20]*\\z"
)

ORDERS = f"""SELECT o_orderkey, o_custkey, o_orderstatus, {micro('o_totalprice')} AS o_totalprice,
  strftime(o_orderdate,'%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders"""


def edges(source: str) -> str:
    return f"""edges AS (SELECT id, parent FROM {source} WHERE parent IN (SELECT id FROM {source}))"""


# From the roots down; a root is a parent that is nobody's child.
ANCESTRY = """tree AS (
  SELECT DISTINCT parent AS id, CAST(NULL AS BIGINT) AS root, CAST(0 AS BIGINT) AS depth, CAST([] AS BIGINT[]) AS path
  FROM edges WHERE parent NOT IN (SELECT id FROM edges)
  UNION ALL
  SELECT e.id, coalesce(t.root, t.id), t.depth+1, list_append(t.path, t.id) FROM edges e JOIN tree t ON e.parent=t.id)"""

THREADS = "SELECT id, root, depth, array_to_string(path, ',') AS path FROM tree"

# Every node has entered once before it is reached, and all but its ancestors have left.
INTERVALS = """SELECT t.id, coalesce(t.root, t.id) AS thread, 2*before-depth AS enter, 2*(before+size)-depth-1 AS leave, size
  FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(root, id) ORDER BY list_append(path, id))-1 AS before FROM tree) t
  JOIN (SELECT id, count(*) AS size FROM (SELECT unnest(list_append(path, id)) AS id FROM tree) GROUP BY id) s ON t.id=s.id"""

SCORED = "type='story' AND score IS NOT NULL AND title IS NOT NULL"

COMMENTED = f"""commented AS (SELECT id, CASE WHEN coalesce(descendants,0)>0 THEN 1 WHEN coalesce(descendants,0)=0 THEN 0 END AS label
  FROM stories WHERE {SCORED} AND coalesce(descendants,0)>=0)"""

DOCUMENT_WORDS = f"SELECT doc_id AS id, {tokens('text')} AS words FROM documents"

RANKED = f"""counts AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM ({DOCUMENT_WORDS})) GROUP BY word),
 ranked AS (SELECT row_number() OVER (ORDER BY n DESC, word)-1 AS word_id, word, n FROM counts)"""

WORDS = RANKED + ", words AS (SELECT word_id, word, n, embedding AS vec FROM ranked JOIN embeddings ON vec_id=word_id)"

# Signed weights first, then one row a position.
ANALOGY = f"""terms AS (SELECT conv_id AS request_id, unnest({tokens('text')}) AS word,
    CASE WHEN role='assistant' THEN 1 ELSE -1 END AS sign FROM conversations),
 weights AS (SELECT request_id, word, sum(sign) AS weight, count(*) AS uses FROM terms GROUP BY ALL),
 known AS (SELECT request_id, weight, uses, vec FROM weights JOIN words USING (word)),
 positions AS (SELECT request_id, i, sum(weight*CAST(vec[i] AS DOUBLE))/sum(uses) AS x
    FROM known, (SELECT unnest(range(1,{EMBEDDING_DIM + 1})) AS i) GROUP BY request_id, i),
 means AS (SELECT request_id, list(x ORDER BY i) AS vec FROM positions GROUP BY request_id),
 uses AS (SELECT request_id, sum(uses) AS known FROM known GROUP BY request_id)"""

CENTROIDS = f"""positions AS (SELECT label AS request_id, i, avg(CAST(vec[i] AS DOUBLE)) AS x
    FROM vectors, (SELECT unnest(range(1,{EMBEDDING_DIM + 1})) AS i) GROUP BY label, i),
 centroids AS (SELECT request_id, list(x ORDER BY i) AS vec FROM positions GROUP BY request_id)"""


def knn(bits: int | None) -> str:
    """The k nearest vectors of every centroid, within its bucket when there are any bits."""
    where = "" if bits is None else f"WHERE {bucket('c.vec', bits)} = {bucket('CAST(v.vec AS DOUBLE[])', bits)}"
    return with_views("vectors", f"""
      SELECT request_id, CAST(rank AS INT) AS rank, id, {micro('distance')} AS distance_micro FROM (
        SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, id) AS rank FROM (
          SELECT c.request_id, v.id, round(1-list_dot_product(c.vec, CAST(v.vec AS DOUBLE[])),9) AS distance
          FROM centroids c, vectors v {where})) WHERE rank<={DEFAULT_K}""", CENTROIDS)


def probed_knn(bits: int, share: float = PROBE_SHARE) -> str:
    """The k nearest vectors of every centroid in the filled buckets of least cost."""
    planes = [f"[{','.join(repr(float(x)) for x in plane)}]::DOUBLE[]" for plane in hyperplanes(bits, EMBEDDING_DIM)]
    side = lambda i, plane: f"""CASE WHEN (list_dot_product(c.vec, {plane})>0) <> (substr(f.bucket,{i + 1},1)='1')
        THEN pow(list_dot_product(c.vec, {plane}), 2)/list_dot_product({plane}, {plane}) ELSE 0 END"""
    cost = "+".join(side(i, plane) for i, plane in enumerate(planes))
    return with_views("vectors", f"""
      SELECT request_id, CAST(rank AS INT) AS rank, id, {micro('distance')} AS distance_micro FROM (
        SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, id) AS rank FROM (
          SELECT p.request_id, v.id, round(1-list_dot_product(p.vec, CAST(v.vec AS DOUBLE[])),9) AS distance
          FROM opened p JOIN hashed v USING (bucket) WHERE place <= greatest(1, floor({share}*(SELECT count(*) FROM filled))))) WHERE rank<={DEFAULT_K}""",
      f"""{CENTROIDS}, hashed AS (SELECT id, vec, {bucket('CAST(vec AS DOUBLE[])', bits)} AS bucket FROM vectors),
      filled AS (SELECT DISTINCT bucket FROM hashed),
      opened AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY cost, bucket) AS place FROM
        (SELECT c.request_id, c.vec, f.bucket, round({cost}, 12) AS cost FROM centroids c, filled f))""")


def seeded(key: str, dim: int, seed: int = 0) -> str:
    """The small start vector: one digest a key, then whole-number steps modulo 2^32 for every position."""
    start = f"CAST('0x'||substr(md5({key}||':{seed}'),1,8) AS BIGINT)"
    first = f"((({start} + i*{STEP}) % {MODULUS})*{FACTOR} + {ADDEND}) % {MODULUS}"
    return f"""list_transform(list_transform(list_transform(range(1,{dim + 1}), lambda i: {first}), lambda x: (xor(x, x >> 15)*{FACTOR}) % {MODULUS}),
      lambda y: CAST(((y >> 8)/16777216.0::DOUBLE-0.5)/{dim} AS FLOAT))"""


# Huffman by weights: each round takes the least weight, joins its first node with the odd one before, and pairs the rest.
# Then nodes get their numbers and places by sums over the rounds, and words climb.
HUFFMAN = RANKED + """,
 leaves AS (SELECT n AS w, count(*) AS size, min(word_id) AS first FROM ranked GROUP BY n),
 rounds(round, w, size, odd, queue) AS (
  SELECT 0, CAST(NULL AS HUGEINT), CAST(0 AS HUGEINT), CAST(NULL AS HUGEINT),
    (SELECT list({'w': CAST(w AS HUGEINT), 's': CAST(size AS HUGEINT)} ORDER BY w) FROM leaves)
  UNION ALL
  SELECT round+1, queue[1].w, queue[1].s,
    CASE WHEN (queue[1].s - (CASE WHEN odd IS NULL THEN 0 ELSE 1 END)) % 2 = 1 THEN queue[1].w END,
    (SELECT list({'w': q.w, 's': q.s} ORDER BY q.w) FROM (
      SELECT u.w, sum(u.s) AS s FROM (SELECT unnest(list_concat(queue[2:], list_filter([
          {'w': queue[1].w + odd, 's': CASE WHEN odd IS NULL THEN CAST(0 AS HUGEINT) ELSE CAST(1 AS HUGEINT) END},
          {'w': 2 * queue[1].w, 's': (queue[1].s - (CASE WHEN odd IS NULL THEN 0 ELSE 1 END)) // 2}], lambda x: x.s > 0))) AS u) GROUP BY u.w) q)
  FROM rounds WHERE len(queue) > 0),
 steps AS (
  SELECT round, w, size, CASE WHEN before IS NULL THEN 0 ELSE 1 END AS taken, before + w AS join_w, 2 * w AS pair_w,
    (size - (CASE WHEN before IS NULL THEN 0 ELSE 1 END)) // 2 AS pairs
  FROM (SELECT *, lag(odd) OVER (ORDER BY round) AS before FROM rounds) WHERE round > 0),
 numbered AS (SELECT *, coalesce(sum(taken + pairs) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS node FROM steps),
 made AS (
  SELECT round, kind, m.w, coalesce(l.size, 0)
    + coalesce(sum(m.size) OVER (PARTITION BY m.w ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM (SELECT round, 'join' AS kind, join_w AS w, 1 AS size FROM steps WHERE taken = 1
        UNION ALL SELECT round, 'pair', pair_w, pairs FROM steps WHERE pairs > 0) m LEFT JOIN leaves l ON l.w = m.w),
 parents AS (
  SELECT n.round, n.w, n.size, n.taken, n.pairs, n.node, n.join_w, j.place AS join_place, n.pair_w, p.place AS pair_place
  FROM numbered n LEFT JOIN made j ON j.round = n.round AND j.kind = 'join' LEFT JOIN made p ON p.round = n.round AND p.kind = 'pair'),
 ups AS (
  SELECT s.*, x.node AS next_node, x.join_w AS next_w, x.join_place AS next_place
  FROM parents s LEFT JOIN parents x ON x.round = s.round + 1),
 climbs(word_id, w, place, code, path, alive) AS (
  SELECT word_id, CAST(n AS HUGEINT), CAST(word_id - first AS HUGEINT), '', '', true FROM ranked JOIN leaves ON n = w
  UNION ALL
  SELECT word_id,
    CASE WHEN paired THEN u.pair_w WHEN joins THEN u.join_w ELSE u.next_w END,
    CASE WHEN paired THEN u.pair_place + (c.place - u.taken) // 2 WHEN joins THEN u.join_place ELSE u.next_place END,
    CASE WHEN paired THEN CAST((c.place - u.taken) % 2 AS VARCHAR) WHEN joins THEN '1' ELSE '0' END || code,
    CAST(CASE WHEN paired THEN u.node + u.taken + (c.place - u.taken) // 2 WHEN joins THEN u.node ELSE u.next_node END AS VARCHAR)
      || CASE WHEN path = '' THEN '' ELSE ',' || path END,
    true
  FROM climbs c JOIN ups u ON u.w = c.w,
    LATERAL (SELECT c.place >= u.taken AND c.place < u.taken + 2 * u.pairs AS paired, c.place = 0 AND u.taken = 1 AS joins)
  WHERE paired OR joins OR u.next_node IS NOT NULL)"""


def sentence_rows(source: str) -> str:
    """Comment sentences of a table with id, type and text."""
    paragraphs = f"list_filter(string_split({plain_text('text')}, chr(10)), lambda s: s <> '')"
    return f"""texts AS (SELECT id, {paragraphs} AS parts FROM {source} WHERE type='comment' AND text IS NOT NULL),
 lines AS (SELECT id, unnest(parts) AS line, CAST(generate_subscripts(parts, 1)-1 AS INT) AS pos FROM texts),
 split AS (SELECT id, pos, list_filter({tokens('line')}, lambda w: length(w)<50) AS words FROM lines),
 comment_rows AS (SELECT id, pos, array_to_string(words,' ') AS sentence FROM split WHERE len(words)>0)"""


def held_out(label: str, labelled: str = "", where: str = "true", sample: str = "") -> str:
    """Held-out rows of a forest on stories with vectors: split by id, label beside it."""
    rows = f"SELECT s.id, {label} AS label FROM stories s WHERE {SCORED} AND {where}"
    kept = f"SELECT id, label FROM labelled JOIN sizes USING (label) WHERE {fraction('class')} < {sample}" if sample else "SELECT * FROM labelled"
    return with_views("stories vectors", f"""SELECT id, {micro('CAST(label AS DOUBLE)')} AS label_micro, true AS in_range
      FROM kept WHERE id IN (SELECT id FROM vectors) AND NOT ({fraction('split')} < 0.7::DOUBLE)""",
      f"labelled AS ({rows}), sizes AS (SELECT label, count(*) AS n FROM labelled GROUP BY label), kept AS ({kept})")


def step_down(node: str, tree: str) -> str:
    """The child of a node of the given forest."""
    feature = f"(11*{tree}+5*{node})%{EMBEDDING_DIM}"
    return f"2*{node}+CASE WHEN CAST(vec[{feature}+1] AS DOUBLE) <= (SELECT threshold FROM means m WHERE m.feature={feature}) THEN 1 ELSE 2 END"


def oracle_sql() -> dict[str, str]:
    sentences = sentence_rows("thread_items") + f""",
 title_rows AS (SELECT id, 0 AS pos, array_to_string({tokens('title')},' ') AS sentence
    FROM thread_items WHERE type='story' AND title IS NOT NULL AND id IS NOT NULL)"""
    ancestry = lambda source, views, body: with_views(views, body, f"{edges(source)}, {ANCESTRY}", recursive=True)
    pair = "FROM vectors a JOIN vectors b ON b.id=a.id+1"
    double = "CAST({} AS DOUBLE[])".format
    dot = f"list_dot_product({double('a.vec')},{double('b.vec')})"
    norm = f"(sqrt(list_dot_product({double('a.vec')},{double('a.vec')}))*sqrt(list_dot_product({double('b.vec')},{double('b.vec')})))"
    both = lambda op: vec_text(f"list_transform(list_zip({double('a.vec')},{double('b.vec')}), lambda z: z[1]{op}z[2])")
    title = "translate(title, chr(10)||chr(9), '  ')"
    return {
        "typed_items_table": with_views("raw_items", TYPED),
        "csv_ingest": with_views("raw_items", TYPED),
        "export_json_roundtrip": ORDERS,
        "export_csv_roundtrip": ORDERS,
        "edge_tsv": with_views("thread_items", "SELECT * FROM edges", edges("thread_items")),
        "ancestry_tsv": ancestry("thread_items", "thread_items",
                                 "SELECT id||chr(9)||array_to_string(path, ',') AS value FROM tree"),
        "root_tsv": ancestry("thread_items", "thread_items", "SELECT id||chr(9)||coalesce(CAST(root AS VARCHAR),'') AS value FROM tree"),
        "corpus_tsv": with_views("stories", f"SELECT {title}||chr(9)||'TITLE_'||id AS value FROM stories WHERE type='story' AND title IS NOT NULL"),
        "corpus_parse": with_views("stories", f"SELECT 'TITLE_'||id AS tag, id, array_to_string({tokens(title)},' ') AS sentence FROM stories WHERE type='story' AND title IS NOT NULL"),
        "libsvm_roundtrip": with_views("vectors", f"SELECT label, {vec_text('vec')} AS vec FROM vectors"),
        "word_vector_text": with_views("vectors", f"SELECT word, {vec_text('vec')} AS vec FROM vectors WHERE word IN (SELECT 'w'||doc_id FROM labels)"),
        "thread_edges": with_views("thread_items", "SELECT * FROM edges", edges("thread_items")),
        "thread_ancestors": with_views("event_tree", THREADS, f"edges AS (SELECT * FROM event_tree), {ANCESTRY}", recursive=True),
        "thread_ancestors_items": ancestry("thread_items", "thread_items", THREADS),
        "thread_ancestors_deep": ancestry("user_chains", "user_chains", THREADS),
        "thread_root": with_views("event_tree", "SELECT id, root, depth FROM tree", f"edges AS (SELECT * FROM event_tree), {ANCESTRY}", recursive=True),
        "thread_intervals": ancestry("part_links", "part_links", INTERVALS),
        "thread_lies_below": with_views("event_tree", """SELECT id, CAST(floor(id / 7.0) AS BIGINT) + 1 AS ancestor,
            list_contains(path, CAST(floor(id / 7.0) AS BIGINT) + 1) AS below FROM tree WHERE root IS NOT NULL""",
            f"edges AS (SELECT * FROM event_tree), {ANCESTRY}", recursive=True),
        "thread_cycles": ancestry("part_links", "part_links", "SELECT id FROM edges WHERE id NOT IN (SELECT id FROM tree)"),
        "scored_story_rows": with_views("stories", f"SELECT id, title, score FROM stories WHERE {SCORED}"),
        "submission_titles": with_views("stories", "SELECT id, title FROM stories WHERE type='story' AND title IS NOT NULL AND id IS NOT NULL"),
        "label_dead": with_views("stories", f"SELECT id, CASE WHEN dead THEN 1 ELSE 0 END AS label FROM stories WHERE {SCORED}"),
        "label_commented": with_views("stories", "SELECT * FROM commented", COMMENTED),
        "class_counts": with_views("stories", "SELECT label, count(*) AS n FROM commented GROUP BY label", COMMENTED),
        "balanced_sample": with_views("stories", f"""SELECT id, label FROM commented JOIN sizes USING (label)
            WHERE {fraction('class')} < least(1.0::DOUBLE, (SELECT min(n) FROM sizes)/n::DOUBLE)""",
            f"{COMMENTED}, sizes AS (SELECT label, count(*) AS n FROM commented GROUP BY label)"),
        "dead_sample": with_views("stories", f"""SELECT id, label FROM labelled JOIN sizes USING (label)
            WHERE {fraction('class')} < least(1.0::DOUBLE, 100/n::DOUBLE)""",
            f"""labelled AS (SELECT id, CASE WHEN dead THEN 1 ELSE 0 END AS label FROM stories WHERE {SCORED}),
            sizes AS (SELECT label, count(*) AS n FROM labelled GROUP BY label)"""),
        "fixed_sample": with_views("thread_items", f"""SELECT * FROM comment_rows
            ORDER BY md5(concat_ws(':',id,pos,'fixed','1')), id, pos LIMIT {SAMPLE_SIZE}""", sentences),
        "hash_split": with_views("stories", f"SELECT id, {fraction('split')} < 0.7::DOUBLE AS is_train FROM stories"),
        "log_label": with_views("stories", f"""SELECT id, score, {micro('ln(score+1.0::DOUBLE)')} AS label_micro,
            {micro('exp(ln(score+1.0::DOUBLE))-1')} AS undone_micro FROM stories WHERE {SCORED}"""),
        "tokenized_documents": f"SELECT id, len(words) AS n, md5(array_to_string(words,' ')) AS digest FROM ({DOCUMENT_WORDS})",
        "html_plaintext": f"SELECT page_id, {plain_text('html')} AS text FROM pages",
        "comment_sentences": with_views("thread_items", "SELECT * FROM comment_rows", sentences),
        "sentence_union": with_views("thread_items", "SELECT * FROM comment_rows UNION ALL SELECT * FROM title_rows", sentences),
        "vocabulary": f"WITH {RANKED} SELECT * FROM ranked",
        "vocabulary_capped": f"WITH {RANKED} SELECT * FROM ranked WHERE n>=2 AND word_id<1000",
        "idf_table": f"""WITH d AS ({DOCUMENT_WORDS}), f AS (SELECT word, count(*) AS df FROM
            (SELECT unnest(list_distinct(words)) AS word FROM d) GROUP BY word)
            SELECT word, df, {micro('ln(((SELECT count(*) FROM d)+1)/(df+1.0::DOUBLE))')} AS idf_micro FROM f""",
        "score_vector_join": with_views("stories vectors", f"SELECT s.id, score, {vec_text('vec')} AS vec FROM stories s JOIN vectors v ON v.id=s.id WHERE {SCORED}"),
        "vector_concat": with_views("vectors", f"SELECT id, label, {vec_text('list_concat(vec, list_reverse(vec))')} AS vec FROM vectors"),
        "tag_vector_join": with_views("stories vectors", f"SELECT s.id, tag, {vec_text('vec')} AS vec FROM stories s JOIN vectors v ON s.tag='TITLE_'||v.id WHERE {SCORED}"),
        "missing_tags": with_views("stories vectors", f"SELECT id, tag FROM stories WHERE {SCORED} AND tag NOT IN (SELECT 'TITLE_'||id FROM vectors)"),
        "vector_arithmetic": with_views("vectors", f"SELECT a.id, {both('+')} AS total, {both('-')} AS difference {pair}"),
        "dot_distance_pairs": with_views("vectors", f"""SELECT a.id, {micro(f'1-{dot}')} AS distance_micro,
            {micro(f'1-(1-{dot})')} AS sim_micro, {micro(f'1-{dot}/{norm}')} AS cosine_micro {pair}"""),
        "word_analogy_vector": f"""WITH {WORDS}, {ANALOGY} SELECT request_id, CAST(coalesce(known,0) AS BIGINT) AS known, {vec_text('vec')} AS vec
            FROM (SELECT DISTINCT request_id FROM terms) LEFT JOIN means USING (request_id) LEFT JOIN uses USING (request_id)""",
        "pretrained_overlay": f"""WITH {RANKED} SELECT word_id, word, vec_id IS NOT NULL AS pretrained,
            md5({vec_text(f"CASE WHEN vec_id IS NOT NULL THEN embedding ELSE {seeded('word', EMBEDDING_DIM)} END")}) AS digest
            FROM ranked LEFT JOIN embeddings ON vec_id=word_id""",
        "lsh_buckets": with_views("vectors", f"SELECT id, {bucket('CAST(vec AS DOUBLE[])', DOCUMENT_BITS)} AS bucket FROM vectors"),
        "lsh_knn_docs": knn(DOCUMENT_BITS),
        "lsh_index_knn": knn(WORD_BITS),
        "exact_knn": knn(None),
        "index_changes": with_views("vectors", f"SELECT id, {bucket('CAST(vec AS DOUBLE[])', WORD_BITS)} AS bucket, {vec_text('vec')} AS vec FROM held",
            "held AS (SELECT id, CASE WHEN id%7=0 AND id%35<>0 THEN list_reverse(vec) ELSE vec END AS vec FROM vectors WHERE id%5<>0 OR id%35=0)"),
        "pruned_knn": with_views("vectors", f"""
            SELECT request_id, CAST(rank AS INT) AS rank, id, {micro('distance')} AS distance_micro FROM (
              SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, id) AS rank FROM (
                SELECT c.id AS request_id, v.id, round(1-list_dot_product(CAST(c.vec AS DOUBLE[]), CAST(v.vec AS DOUBLE[])),9) AS distance
                FROM vectors c, vectors v WHERE c.id%20=0)) WHERE rank<={DEFAULT_K}"""),
        "multiprobe_knn": probed_knn(DOCUMENT_BITS),
        "multiprobe_recall": " UNION ALL ".join(f"""SELECT {round(100 * share)} AS percent, count(*) AS wanted, count(f.id) AS hits
            FROM ({knn(None)}) e LEFT JOIN ({probed_knn(DOCUMENT_BITS, share)}) f ON e.request_id=f.request_id AND e.id=f.id""" for share in RECALL_SHARES),
        "similar_words": f"""WITH {WORDS}, {ANALOGY},
            asked AS (SELECT request_id, vec, {bucket('vec', WORD_BITS)} AS bucket FROM means
                WHERE request_id IN (SELECT request_id FROM terms WHERE sign>0)),
            stored AS (SELECT word, vec, {bucket('CAST(vec AS DOUBLE[])', WORD_BITS)} AS bucket FROM words),
            found AS (SELECT request_id, word, s.vec, round(1-list_dot_product(a.vec, CAST(s.vec AS DOUBLE[])),9) AS distance
                FROM asked a JOIN stored s USING (bucket))
            SELECT request_id, CAST(rank AS INT) AS rank, word, {micro('1-distance')} AS sim_micro, {vec_text('vec')} AS vec FROM
                (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, word) AS rank FROM found) WHERE rank<={DEFAULT_K}""",
        "csv_header_ingest": with_views("raw_items", TYPED),
        "typed_items_sql": with_views("raw_items", f"SELECT author, score, title, type, parent, deleted, descendants, id FROM ({TYPED})"),
        "json_titles": f"""SELECT item_id AS id, text AS title, 'title' AS kind FROM benchmark UNION ALL
            SELECT row_number() OVER (ORDER BY word)-1, word, 'word' FROM (SELECT DISTINCT unnest({tokens('text')}) AS word FROM benchmark)""",
        "vector_table_roundtrip": with_views("vectors", f"SELECT id, {vec_text('vec')} AS vec FROM vectors"),
        "page_sentences": f"""WITH page_items AS (SELECT page_id AS id, 'comment' AS type, html AS text FROM pages), {sentence_rows('page_items')}
            SELECT * FROM comment_rows""",
        "rf_score_log": held_out("ln(score+1.0::DOUBLE)"),
        "rf_score_raw": held_out("score"),
        "rf_score_concat": held_out("score"),
        "rf_comment_count": held_out("ln(coalesce(descendants,0)+1.0::DOUBLE)"),
        "rf_dead": held_out("CASE WHEN dead THEN 1 ELSE 0 END", sample="least(1.0::DOUBLE, 300000/n::DOUBLE)"),
        "rf_commented": held_out("CASE WHEN coalesce(descendants,0)>0 THEN 1 ELSE 0 END", where="coalesce(descendants,0)>=0",
            sample="least(1.0::DOUBLE, (SELECT min(n) FROM sizes)/n::DOUBLE)"),
        "rf_tfidf": with_views("stories", f"""SELECT id, {micro('CAST(score AS DOUBLE)')} AS label_micro, true AS in_range
            FROM stories WHERE {SCORED} AND NOT ({fraction('split')} < 0.7::DOUBLE)"""),
        "model_roundtrip": with_views("stories vectors", f"""SELECT id, true AS same FROM stories
            WHERE {SCORED} AND id IN (SELECT id FROM vectors) AND NOT ({fraction('split')} < 0.7::DOUBLE)"""),
        "forest_nodes": f"""SELECT 'score' AS forest, id, true AS same FROM ({held_out('score')}) UNION ALL SELECT 'commented', id, true FROM ({held_out(
            "CASE WHEN coalesce(descendants,0)>0 THEN 1 ELSE 0 END", where="coalesce(descendants,0)>=0",
            sample="least(1.0::DOUBLE, (SELECT min(n) FROM sizes)/n::DOUBLE)")})""",
        "node_table_predictions": with_views("vectors", f"""SELECT id, {micro('avg(tree + node/10.0::DOUBLE)')} AS prediction_micro FROM third GROUP BY id""",
            f"""means AS (SELECT i-1 AS feature, round(avg(CAST(vec[i] AS DOUBLE)),4) AS threshold
              FROM vectors, (SELECT unnest(range(1,{EMBEDDING_DIM + 1})) AS i) GROUP BY i),
            first AS (SELECT id, vec, tree, {step_down('0', 'tree')} AS node FROM vectors, range(5) t(tree)),
            second AS (SELECT id, vec, tree, {step_down('node', 'tree')} AS node FROM first),
            third AS (SELECT id, tree, {step_down('node', 'tree')} AS node FROM second)"""),
        "forest_report": f"SELECT count(*) AS n, true AS mse_known, CAST(5 AS BIGINT) AS n_trees FROM ({held_out('ln(score+1.0::DOUBLE)')})",
        "class_report": "SELECT true AS false_positive, true AS false_negative, CAST(3 AS BIGINT) AS n_trees",
        "word_vectors": with_views("thread_items", """SELECT DISTINCT word, 100 AS width, true AS finite FROM (
            SELECT unnest(string_split(sentence, ' ')) AS word FROM (SELECT sentence FROM comment_rows UNION ALL SELECT sentence FROM title_rows)) WHERE word<>''""", sentences),
        "huffman_codes": f"""WITH RECURSIVE {HUFFMAN}
            SELECT word_id, word, n, code, path FROM ranked JOIN (SELECT word_id, arg_max(code, length(code)) AS code, arg_max(path, length(code)) AS path
              FROM climbs GROUP BY word_id) USING (word_id)""",
        "mean_doc_vectors": f"""WITH {WORDS}, uses AS (SELECT id, word, count(*) AS uses FROM (SELECT id, unnest(words) AS word FROM ({DOCUMENT_WORDS})) GROUP BY ALL),
            known AS (SELECT id, uses, vec FROM uses JOIN words USING (word)),
            positions AS (SELECT id, i, sum(uses*CAST(vec[i] AS DOUBLE))/sum(uses) AS x FROM known, (SELECT unnest(range(1,{EMBEDDING_DIM + 1})) AS i) GROUP BY id, i),
            means AS (SELECT id, list(x ORDER BY i) AS vec FROM positions GROUP BY id)
            SELECT doc_id AS id, {vec_text('vec')} AS vec FROM documents LEFT JOIN means ON id=doc_id""",
        "update_sums": with_views("vectors", f"""SELECT word_id, {vec_text('list(squares ORDER BY i)')} AS squares, {vec_text('list(vec ORDER BY i)')} AS vec FROM (
            SELECT word_id, i, 0.5::DOUBLE+g*g AS squares, CAST(g*0.025::DOUBLE/(1e-6::DOUBLE+sqrt(0.5::DOUBLE+g*g)) AS FLOAT) AS vec FROM (
              SELECT CAST(label AS BIGINT) AS word_id, i, sum(CAST(vec[i] AS DOUBLE))/0.025::DOUBLE AS g
              FROM vectors, (SELECT unnest(range(1,{EMBEDDING_DIM + 1})) AS i) GROUP BY 1, 2)) GROUP BY word_id"""),
        "paragraph_vectors": "SELECT doc_id AS id, 100 AS width, true AS finite FROM documents",
        "paragraph_vectors_pretrained": f"SELECT doc_id AS id, {EMBEDDING_DIM} AS width, true AS finite FROM documents",
        "infer_vectors": "SELECT item_id AS id, 100 AS width, true AS finite FROM benchmark",
        "similar_titles": with_views("vectors stories", f"""SELECT request_id, CAST(rank AS INT) AS rank, f.id, md5(title) AS title, {micro('1-distance')} AS sim_micro FROM
            (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, id) AS rank FROM near) f
            LEFT JOIN stories s ON s.id=f.id AND type='story' AND title IS NOT NULL WHERE rank<={DEFAULT_K}""", f"""{WORDS},
            requests AS (SELECT item_id AS request_id, {tokens('text')} AS parts, CAST(vec AS DOUBLE[]) AS start FROM benchmark JOIN vectors ON id=item_id+1),
            given AS (SELECT word, CAST(vec AS DOUBLE[]) AS vec FROM words),
            moved AS (SELECT request_id, list_transform(range(1,{EMBEDDING_DIM + 1}), lambda i: start[i]
                + (coalesce(p.vec[i], 0) - coalesce(m.vec[i], 0))) AS vec
              FROM requests LEFT JOIN given p ON p.word=parts[1] LEFT JOIN given m ON m.word=parts[-1]),
            asked AS (SELECT request_id, vec, {bucket('vec', WORD_BITS)} AS bucket FROM moved),
            stored AS (SELECT id, vec, {bucket('CAST(vec AS DOUBLE[])', WORD_BITS)} AS bucket FROM vectors),
            near AS (SELECT request_id, id, round(1-list_dot_product(a.vec, CAST(s.vec AS DOUBLE[])),9) AS distance FROM asked a JOIN stored s USING (bucket))"""),
        "score_titles": "SELECT item_id AS request_id, 0 AS pos, text AS sentence, true AS tfidf, true AS docvec, true AS docvec2, 100 AS width FROM benchmark",
        "score_stream": "SELECT CAST(item_id AS VARCHAR) AS request_id, 0 AS pos, text AS sentence, 1 AS results, true AS as_batch FROM benchmark",
        "mse_metric": """SELECT count(*) AS n, round(avg(pow(o_totalprice-(150000.0::DOUBLE+o_custkey%1000),2)),2) AS mse FROM orders""",
        "error_rates": """SELECT round(count(*) FILTER (quality=0 AND toxic<>0)/nullif(count(*) FILTER (quality=0),0)::DOUBLE,6) AS false_positive,
            round(count(*) FILTER (quality=1 AND toxic<>1)/nullif(count(*) FILTER (quality=1),0)::DOUBLE,6) AS false_negative FROM labels""",
    }
