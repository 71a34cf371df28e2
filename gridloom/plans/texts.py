"""Text operators on ``documents``, ``conversations``, ``benchmark`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import arrays as A
from gridloom.functions import text as X
from gridloom.operators import batching as B
from gridloom.operators import ordering as O
from gridloom.operators import sentence_pairs as S
from gridloom.operators import tensors as T
from gridloom.operators import vocabulary as V
from gridloom.plans.registry import draw_sql, query, r6, uniform_sql
from gridloom.session import cut_lineage, spread

PUNCT = r"[\p{P}$+<=>^`|~]"
TOKEN = r"[\p{P}$+<=>^`|~]|[^\s\x0B\p{P}$+<=>^`|~]+"
# One row per document and token, as the default text steps produce them.
TOKENS = rf"""tok AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM
    (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM documents))"""
# Vocabulary with four reserved tokens and a least frequency of 10.
VOCAB = """vocab AS (SELECT token, freq, row_number() OVER (ORDER BY freq DESC, token) + 3 AS id FROM
    (SELECT token, count(*) AS freq FROM tok GROUP BY 1 HAVING count(*) >= 10)
    UNION ALL SELECT * FROM (VALUES ('<bos>', 0, 0), ('<eos>', 0, 1), ('<pad>', 0, 2), ('<unk>', 0, 3)) r(token, freq, id))"""
RESERVED = [X.BEGIN, X.END, X.PADDING]


def texts(t):
    return spread(t.documents.select("doc_id", "text"), "doc_id")


def tokens(t):
    return texts(t).select("doc_id", X.default_tokens(F.col("text")).alias("tokens"))


def vocabulary(df, **options):
    return V.build_vocabulary(df, "tokens", **{"min_frequency": 10, "reserved": RESERVED, **options})


def exploded(df, array, *keys, name="token"):
    out = T.explode_rows(df, array, list(keys), value=name)
    return out.withColumn("pos", F.col("pos").cast("long"))


@query("split_and_join", "F20 F21", r"""
WITH s AS (SELECT doc_id, CASE WHEN text = '' THEN [''] WHEN regexp_full_match(text, ' +') THEN []
ELSE string_split(regexp_replace(text, ' +$', ''), ' ') END AS t FROM documents)
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, '_')) AS joined, md5(lower(array_to_string(t, ' '))) AS lowered FROM s""")
def split_and_join(t):
    parts = X.split_spaces(F.col("text"))
    out = t.documents.select("doc_id", parts.alias("t"))
    return out.select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(X.join_tokens(F.col("t"), "_")).alias("joined"),
        F.md5(X.join_tokens(X.lower_tokens(F.col("t")))).alias("lowered"),
    )


@query("default_text_tokens", "F22 F30 D15", rf"""
WITH s AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM documents)
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest, len(list_filter(t, lambda x: regexp_full_match(x, '{PUNCT}'))) AS n_marks FROM s""")
def default_text_tokens(t):
    steps = X.process(F.col("text"), lambda a: F.flatten(F.transform(a, X.split_spaces)), X.lower_tokens, X.separate_punctuation)
    out = t.documents.select("doc_id", steps.alias("t"))
    return out.select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(X.join_tokens(F.col("t"))).alias("digest"),
        F.size(F.filter("t", X.is_punctuation)).cast("long").alias("n_marks"),
    )


@query("character_classes", "F25 F26", r"""
SELECT page_id, len(regexp_replace(html, '[^\pZ\t\n\x0B\f\r\x1C-\x1F]', '', 'g')) AS blanks,
len(regexp_replace(html, '[^\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g')) AS controls,
len(regexp_replace(html, '[^\p{P}$+<=>^`|~]', '', 'g')) AS marks,
md5(regexp_replace(regexp_replace(html, '[\p{P}$+<=>^`|~]', '', 'g'), '[\pZ\t\n\x0B\f\r\x1C-\x1F]', ' ', 'g')) AS cleaned FROM pages""")
def character_classes(t):
    html = F.col("html")

    def count(pattern):
        return F.length(X.remove_matching(html, f"[^{pattern[1:-1]}]")).cast("long")

    cleaned = X.replace_matching(X.remove_matching(html, X.PUNCTUATION), X.WHITESPACE, " ")
    return t.pages.select(
        "page_id", count(X.WHITESPACE).alias("blanks"), count(X.CONTROL).alias("controls"),
        count(X.PUNCTUATION).alias("marks"), F.md5(cleaned).alias("cleaned"),
    )


@query("hyphens", "F23", r"""
SELECT doc_id, md5(regexp_replace(replace(text, chr(173), ''),
'[\-~\x{58A}\x{5BE}\x{2010}-\x{2015}\x{2053}\x{207B}\x{208B}\x{2212}\x{2E3A}\x{2E3B}\x{301C}\x{3030}\x{FE31}\x{FE32}\x{FE58}\x{FE63}\x{FF0D}]', '-', 'g')) AS digest FROM documents""")
def hyphens(t):
    return t.documents.select("doc_id", F.md5(X.normalize_hyphens(F.col("text"))).alias("digest"))


@query("unicode_nfc", "F24", "SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def unicode_nfc(t):
    return t.documents.select("doc_id", F.md5(X.unicode_normal(F.col("text"), "NFC")).alias("digest"))


@query("truncated_tokens", "F27", rf"""
WITH s AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM documents) SELECT doc_id, array_to_string(t[1:8], ' ') AS cut FROM s""")
def truncated_tokens(t):
    return tokens(t).select("doc_id", X.join_tokens(X.truncate_tokens(F.col("tokens"), 8)).alias("cut"))


@query("truncate_and_terminate", "F28 F29", rf"""
WITH s AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM documents)
SELECT doc_id, md5(array_to_string(list_concat(['<bos>'], t, ['<eos>']), ' ')) AS closed,
md5(array_to_string(list_transform(t, lambda x: x || '!'), ' ')) AS mapped FROM s""")
def truncate_and_terminate(t):
    return tokens(t).select(
        "doc_id", F.md5(X.join_tokens(X.terminate_tokens(F.col("tokens")))).alias("closed"),
        F.md5(X.join_tokens(X.map_tokens(F.col("tokens"), lambda x: F.concat(x, F.lit("!"))))).alias("mapped"),
    )


@query("token_counts", "A14", f"WITH {TOKENS} SELECT token, count(*) AS freq FROM tok GROUP BY 1")
def token_counts(t):
    return V.token_counts(tokens(t), "tokens")


@query("vocabulary", "D13 S19", f"WITH {TOKENS}, {VOCAB} SELECT token, freq, id FROM vocab")
def vocabulary_table(t):
    return vocabulary(tokens(t))


@query("capped_dictionary", "O05", f"""
WITH {TOKENS}, c AS (SELECT token, count(*) AS freq FROM tok GROUP BY 1)
SELECT token, freq, id FROM (SELECT token, freq, row_number() OVER (ORDER BY freq DESC, token) + 3 AS id FROM c) WHERE id < 1000
UNION ALL SELECT * FROM (VALUES ('<unk>', 0, 0), ('<cls>', 0, 1), ('<sep>', 0, 2), ('<msk>', 0, 3)) r(token, freq, id)""")
def capped_dictionary(t):
    return V.build_vocabulary(tokens(t), "tokens", 1, X.CODE_RESERVED, X.CODE_RESERVED[0], max_size=1000)


@query("encode_tokens", "J01 D14", f"""
WITH {TOKENS}, {VOCAB} SELECT doc_id, pos, coalesce(id, 3) AS id, CASE WHEN id IS NULL THEN '<unk>' ELSE token END AS kept
FROM tok LEFT JOIN vocab USING (token)""")
def encode_tokens(t):
    base = tokens(t)
    vocab = vocabulary(base)
    ids = V.encode(base, "tokens", vocab, "doc_id")
    out = exploded(ids.select("doc_id", F.arrays_zip("tokens", "ids").alias("k")), "k", "doc_id", name="x")
    return out.select("doc_id", "pos", F.col("x.ids").alias("id"), F.when(F.col("x.ids") == 3, X.UNKNOWN).otherwise(F.col("x.tokens")).alias("kept"))


@query("decode_until_end", "J03", f"""
WITH {TOKENS}, {VOCAB}, e AS (SELECT doc_id, pos, coalesce(id, 3) AS id FROM tok LEFT JOIN vocab USING (token)),
stop AS (SELECT doc_id, min(pos) AS stop FROM e WHERE id = 8 GROUP BY 1)
SELECT doc_id, count(token) AS n, md5(coalesce(string_agg(token, ' ' ORDER BY pos), '')) AS digest FROM documents LEFT JOIN
(SELECT doc_id, pos, v.token FROM e JOIN vocab v USING (id) LEFT JOIN stop USING (doc_id) WHERE pos < coalesce(stop, 1000000000)) USING (doc_id) GROUP BY 1""")
def decode_until_end(t):
    base = tokens(t)
    vocab = vocabulary(base)
    stop = vocab.filter(F.col("id") == 8).first()["token"]
    ids = V.encode(base, "tokens", vocab, "doc_id").select("doc_id", "ids")
    out = V.decode(ids, "ids", vocab, "doc_id", stop=stop)
    return out.select("doc_id", F.size("tokens").cast("long").alias("n"), F.md5(X.join_tokens(F.col("tokens"))).alias("digest"))


@query("simple_bert_split", "F33", r"""
WITH w AS (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM
(SELECT item_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS t FROM benchmark)),
x AS (SELECT item_id, p * 2 AS p, CASE WHEN regexp_matches(w, '.[.,?!]$') THEN w[:-2] ELSE w END AS token FROM w
UNION ALL SELECT item_id, p * 2 + 1, w[-1:] FROM w WHERE regexp_matches(w, '.[.,?!]$'))
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY p) - 1 AS pos, token FROM x""")
def simple_bert_split(t):
    return exploded(t.benchmark.select("item_id", X.simple_bert_tokens(F.col("text")).alias("t")), "t", "item_id")


PAIRS = r"""pairs AS (SELECT q.conv_id, q.turn, q.text AS qt, a.text AS ans FROM conversations q JOIN conversations a
    ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant')"""


def question_pairs(t):
    c = t.conversations
    q = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("qt"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ans"))
    return q.join(a, ["conv_id", "turn"])


@query("encode_question_pairs", "F34", rf"""
WITH {PAIRS}, n AS (SELECT conv_id, turn, qt, ans,
len(regexp_extract_all(qt, '[^ \t\n\x0B\f\r]+')) + len(regexp_extract_all(qt, '[^ \t\n\x0B\f\r][.,?!]([ \t\n\x0B\f\r]|$)')) AS q,
len(regexp_extract_all(ans, '[^ \t\n\x0B\f\r]+')) + len(regexp_extract_all(ans, '[^ \t\n\x0B\f\r][.,?!]([ \t\n\x0B\f\r]|$)')) AS a FROM pairs)
SELECT conv_id, turn, q + a AS valid_length, greatest(q + a + 3, 64) AS width, a + 1 AS second_type, q + a + 3 AS attended,
greatest(64 - (q + a + 3), 0) AS padding FROM n""")
def encode_question_pairs(t):
    parts = X.encode_pair(F.col("q"), F.col("a"), 64)
    pairs = question_pairs(t).select(
        "conv_id", "turn", X.simple_bert_tokens(F.col("qt")).alias("q"), X.simple_bert_tokens(F.col("ans")).alias("a")
    )
    e = pairs.select("conv_id", "turn", *[c.alias(n) for n, c in parts.items()])

    def ones(name):
        return F.aggregate(name, F.lit(0).cast("long"), lambda s, x: s + x)

    return e.select(
        "conv_id", "turn", F.col("valid_length").cast("long").alias("valid_length"), F.size("tokens").cast("long").alias("width"),
        ones("types").alias("second_type"), ones("mask").alias("attended"),
        F.size(F.filter("tokens", lambda x: x == X.BERT_PADDING)).cast("long").alias("padding"),
    )


@query("camel_case_tokens", "F35 S17", r"""
WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS line_no, regexp_replace(unnest(s), '[\s\x0B]+$', '') AS line FROM
(SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS s FROM documents))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS line_no, CASE WHEN length(line) = 1 THEN line ELSE
array_to_string(list_transform(regexp_extract_all(line, '\p{Lu}[\p{Ll}\p{Lo}\p{Lm}\p{Lt}]*|[\p{Ll}\p{Lo}\p{Lm}\p{Lt}]+|[^\p{L}]'), lambda x: lower(x)), '_') END AS joined
FROM l WHERE line <> ''""")
def camel_case_tokens(t):
    lines = texts(t).select("doc_id", F.posexplode(X.code_lines(F.col("text"))).alias("line_no", "line"))
    return lines.select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), X.join_tokens(X.camel_case_tokens(F.col("line")), "_").alias("joined")
    )


@query("fixed_width_ids", "F36", f"""
WITH {TOKENS}, {VOCAB}, e AS (SELECT doc_id, pos, coalesce(id, 3) AS id FROM tok LEFT JOIN vocab USING (token)),
k AS (SELECT doc_id, pos FROM documents, (SELECT unnest(range(48)) AS pos))
SELECT doc_id, pos, coalesce(id, 2) AS id FROM k LEFT JOIN e USING (doc_id, pos)""")
def fixed_width_ids(t):
    base = tokens(t)
    vocab = vocabulary(base)
    ids = V.encode(base, "tokens", vocab, "doc_id")
    return exploded(ids.select("doc_id", A.fit(F.col("ids"), F.lit(2).cast("long"), 48).alias("i")), "i", "doc_id", name="id")


def piece_vocabulary(t):
    """Single characters, their continuations and the frequent words of the documents."""
    base = texts(t).select("doc_id", X.bert_basic_tokens(F.col("text")).alias("tokens"))
    counts = cut_lineage(V.token_counts(base, "tokens"))
    words = counts.filter("freq >= 20").select("token")
    chars = counts.select(F.explode(F.split("token", "")).alias("token")).filter("token <> ''").distinct()
    pieces = words.unionByName(chars).unionByName(chars.select(F.concat(F.lit("##"), "token").alias("token"))).distinct()
    special = t.spark.createDataFrame([(x, i) for i, x in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]"])], "token string, id long")
    sized = cut_lineage(pieces.withColumn("len", F.length("token")))
    ranked = O.ordered_prefix(sized, "len", "token", index="id", descending=True)
    return base, special.unionByName(ranked.select("token", (F.col("id") + 4).alias("id")))


BASIC = rf"""basic AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(regexp_replace(regexp_replace(text,
    '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}\x{{FFFD}}]', '', 'g'), '[\pZ\t\n\x0B\f\r\x1C-\x1F]', ' ', 'g'))), '{TOKEN}') AS t FROM documents),
    bt AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM basic),
    bc AS (SELECT token, count(*) AS n FROM bt GROUP BY 1),
    bw AS (SELECT token FROM bc WHERE n >= 20),
    ch AS (SELECT DISTINCT unnest(string_split(token, '')) AS c FROM bc),
    pre AS (SELECT token, e FROM (SELECT token, unnest(range(1, length(token) + 1)) AS e FROM bc) WHERE e = 1 OR token[1:e] IN (SELECT token FROM bw)),
    best AS (SELECT token, max(e) AS e FROM pre GROUP BY 1),
    pieces AS (SELECT token, CASE WHEN length(token) > 200 THEN ['[UNK]'] WHEN e = length(token) THEN [token]
        ELSE list_concat([token[1:e]], ['##' || c FOR c IN string_split(token[e + 1:], '')]) END AS p FROM best),
    pt AS (SELECT doc_id, pos, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM bt JOIN pieces USING (token)),
    pv AS (SELECT piece, row_number() OVER (ORDER BY length(piece) DESC, piece) + 3 AS id FROM (SELECT token AS piece FROM bw UNION SELECT c FROM ch UNION SELECT '##' || c FROM ch)
        UNION ALL SELECT * FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[CLS]', 2), ('[SEP]', 3)) r(piece, id))"""


@query("word_piece_tokens", "F31 F32", f"""
WITH {BASIC}, g AS (SELECT doc_id, count(*) AS pieces, md5(string_agg(piece, ' ' ORDER BY pos, k)) AS digest FROM pt GROUP BY 1)
SELECT b.doc_id, len(t) AS words, coalesce(pieces, 0) AS pieces, coalesce(digest, md5('')) AS digest FROM basic b LEFT JOIN g USING (doc_id)""")
def word_piece_tokens(t):
    base, vocab = piece_vocabulary(t)
    out = V.word_pieces(base, "tokens", vocab, "doc_id")
    return out.select(
        "doc_id", F.size("tokens").cast("long").alias("words"), F.size("pieces").cast("long").alias("pieces"), F.md5(X.join_tokens(F.col("pieces"))).alias("digest")
    )


@query("review_features", "F37 F38", f"""
WITH {BASIC}, r AS (SELECT doc_id, piece, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) AS r FROM pt),
g AS (SELECT doc_id, list(id ORDER BY r) AS ids FROM r JOIN pv USING (piece) WHERE r <= 62 GROUP BY 1),
c AS (SELECT doc_id, quality, list_concat([2], coalesce(ids, []), [3]) AS ids FROM labels LEFT JOIN g USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM documents))
SELECT doc_id, quality::DOUBLE AS label, array_to_string([coalesce(ids[i], 0) FOR i IN range(1, 65)], ' ') AS ids, len(ids)::INT AS attended, 64 AS mask_width FROM c""")
def review_features(t):
    base, vocab = piece_vocabulary(t)
    pieces = V.word_pieces(base, "tokens", vocab, "doc_id")
    closed = pieces.withColumn("t", X.terminate_tokens(X.truncate_tokens(F.col("pieces"), 62), X.BERT_CLASS, X.BERT_SEPARATOR))
    ids = V.encode(closed, "t", vocab, "doc_id", unknown=X.BERT_UNKNOWN)
    labelled = ids.join(t.labels.select("doc_id", X.review_star_label(F.col("quality") + 1).alias("label")), "doc_id")
    zero = F.lit(0).cast("long")
    return labelled.select(
        "doc_id", "label", X.join_tokens(A.fit(F.col("ids"), zero, 64).cast("array<string>")).alias("ids"),
        F.size("ids").alias("attended"), F.size(A.fit(F.transform("ids", lambda x: F.lit(1)), F.lit(0), 64)).alias("mask_width"),
    )


@query("translation_pairs", "F39 S06", rf"""
WITH {PAIRS}, s AS (SELECT conv_id, turn, regexp_extract_all(lower(qt), '{TOKEN}') AS q, regexp_extract_all(lower(ans), '{TOKEN}') AS a FROM pairs)
SELECT conv_id, turn, array_to_string(q[1:10], ' ') AS source, array_to_string(list_concat(['<bos>'], a[1:8], ['<eos>']), ' ') AS target FROM s""")
def translation_pairs(t):
    return question_pairs(t).select(
        "conv_id", "turn", X.join_tokens(X.truncate_tokens(X.default_tokens(F.col("qt")), 10)).alias("source"),
        X.join_tokens(X.terminate_tokens(X.truncate_tokens(X.default_tokens(F.col("ans")), 8))).alias("target"),
    )


@query("sorted_by_length", "O06", f"""
WITH n AS (SELECT doc_id, len(regexp_extract_all(lower(text), '{TOKEN}')) AS n FROM documents)
SELECT doc_id, n, row_number() OVER (ORDER BY n, doc_id) - 1 AS place FROM n""")
def sorted_by_length(t):
    sized = cut_lineage(tokens(t).select("doc_id", F.size("tokens").cast("long").alias("n")))
    return O.ordered_prefix(sized, "n", "doc_id", index="place")


@query("length_buckets", "D12", f"""
WITH n AS (SELECT doc_id, len(regexp_extract_all(lower(text), '{TOKEN}')) AS n FROM documents),
m AS (SELECT min(n) AS lo, max(n) AS hi, greatest((1 + max(n) - min(n)) // 10, 1) AS step FROM n),
k AS (SELECT DISTINCT greatest(hi - (10 - i - 1) * step, lo) AS bucket_key FROM m, (SELECT unnest(range(10)) AS i)),
b AS (SELECT doc_id, n, (SELECT min(bucket_key) FROM k WHERE bucket_key >= n) AS bucket_key FROM n),
p AS (SELECT *, row_number() OVER (PARTITION BY bucket_key ORDER BY n, doc_id) - 1 AS r FROM b)
SELECT doc_id, n, bucket_key, r // 16 AS batch_no, r % 16 AS pos FROM p""")
def length_buckets(t):
    sized = cut_lineage(tokens(t).select("doc_id", F.size("tokens").cast("long").alias("n")))
    out = B.bucket_batches(sized, "n", 10, 16, "doc_id")
    return out.withColumn("bucket_key", F.col("bucket_key").cast("long"))


@query("padded_batches", "D10 D11", f"""
WITH {TOKENS}, n AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch_id,
len(regexp_extract_all(lower(text), '{TOKEN}')) AS valid_length FROM documents)
SELECT doc_id, batch_id, valid_length, max(valid_length) OVER (PARTITION BY batch_id) AS width,
max(valid_length) OVER (PARTITION BY batch_id) - valid_length AS padding, true AS restored FROM n""")
def padded_batches(t):
    out = B.pad_batches(O.batches(tokens(t), 32, "doc_id", wide=True), "tokens", "batch_id", F.lit(X.PADDING))
    return out.select(
        "doc_id", "batch_id", F.col("valid_length").cast("long").alias("valid_length"),
        F.size("padded").cast("long").alias("width"),
        F.size(F.filter("padded", lambda x: x == X.PADDING)).cast("long").alias("padding"),
        (B.unpad(F.col("padded"), F.col("valid_length")) == F.col("tokens")).alias("restored"),
    )


LINES = r"""lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS r FROM
    (SELECT doc_id, generate_subscripts(s, 1) AS line_no, regexp_replace(unnest(s), '[\s\x0B]+$', '') AS line FROM
    (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS s FROM documents)) WHERE line <> '')"""


@query("line_pairs", "W03", f"""
WITH {LINES} SELECT doc_id, r // 2 AS pair_no, min(line) FILTER (r % 2 = 0) AS a, min(line) FILTER (r % 2 = 1) AS b
FROM lines GROUP BY 1, 2 HAVING count(*) = 2""")
def line_pairs(t):
    return pairs_of_lines(t).withColumn("pair_no", F.col("pair_no").cast("long"))


def pairs_of_lines(t):
    return S.line_pairs(texts(t).select("doc_id", X.code_lines(F.col("text")).alias("lines")), "lines", "doc_id")


@query("truncated_pairs", "D17", rf"""
WITH {LINES}, p AS (SELECT doc_id, r // 2 AS pair_no, min(line) FILTER (r % 2 = 0) AS a, min(line) FILTER (r % 2 = 1) AS b
FROM lines GROUP BY 1, 2 HAVING count(*) = 2),
n AS (SELECT doc_id, pair_no, len(regexp_extract_all(lower(a), '{TOKEN}')) AS a, len(regexp_extract_all(lower(b), '{TOKEN}')) AS b FROM p),
o AS (SELECT *, greatest(a + b - 20, 0) AS over FROM n),
c AS (SELECT *, least(a, greatest((over + 1) // 2, over - b)) AS cut FROM o)
SELECT doc_id, pair_no, a - cut AS left_a, b - (over - cut) AS left_b FROM c""")
def truncated_pairs(t):
    a, b = S.truncate_pair(X.default_tokens(F.col("a")), X.default_tokens(F.col("b")), 20)
    return pairs_of_lines(t).select(
        "doc_id", F.col("pair_no").cast("long").alias("pair_no"), F.size(a).cast("long").alias("left_a"),
        F.size(b).cast("long").alias("left_b"),
    )


def next_sentences(t):
    pairs = pairs_of_lines(t).withColumn("pair_id", F.concat_ws("-", "doc_id", "pair_no"))
    return S.swap_half(cut_lineage(pairs), "pair_id", seed=7)


PAIR_SQL = f"""{LINES}, p AS (SELECT doc_id, r // 2 AS pair_no, min(line) FILTER (r % 2 = 0) AS a, min(line) FILTER (r % 2 = 1) AS b
    FROM lines GROUP BY 1, 2 HAVING count(*) = 2)"""


@query("swapped_sentences", "W04 D16", f"WITH {PAIR_SQL} SELECT md5(a) AS sentence, 'a' AS side FROM p UNION ALL SELECT md5(b), 'b' FROM p")
def swapped_sentences(t):
    """Swapping moves first sentences between pairs but neither loses nor adds any."""
    swapped = next_sentences(t)
    first = swapped.select(F.md5("a").alias("sentence"), F.lit("a").alias("side"))
    return first.unionByName(swapped.select(F.md5("b").alias("sentence"), F.lit("b").alias("side")))


@query("masked_totals", "D18 D17", rf"""
WITH {PAIR_SQL}, n AS (SELECT len(regexp_extract_all(lower(b), '{TOKEN}')) AS b FROM p)
SELECT count(*) AS rows, 128 AS width, 20 AS mask_width, true AS ids_kept, true AS masks_agree FROM n""")
def masked_totals(t):
    """Widths, the share of masked places and the stored labels of all masked-token rows."""
    rows = masked_instances(t)
    part = lambda c: F.split(c, " ").cast("array<long>")
    flat = rows.select("length", *[part(c).alias(c) for c in ("token_ids", "input_mask", "masked_positions", "masked_ids", "label_mask")])
    masked = A.total(F.col("label_mask").cast("array<double>"))
    shown = F.zip_with("token_ids", F.sequence(F.lit(0), F.lit(127)), lambda x, p: F.struct(x.alias("x"), p.alias("p")))
    # Only masked places may carry the mask id.
    leaked = F.size(F.filter(shown, lambda s: (s["x"] == 3) & ~F.array_contains(F.slice("masked_positions", F.lit(1), masked.cast("int")), s["p"].cast("long"))))
    return flat.agg(
        F.count("*").alias("rows"), F.max(F.size("token_ids")).alias("width"), F.max(F.size("masked_ids")).alias("mask_width"),
        F.bool_and(leaked == 0).alias("ids_kept"),
        F.bool_and((masked == F.least(F.floor(F.col("length") / 5), F.lit(20))) & (A.total(F.col("input_mask").cast("array<double>")) == F.col("length"))).alias("masks_agree"),
    )


@query("next_sentence_pairs", "W04 D16", f"""
WITH {PAIR_SQL}, k AS (SELECT *, doc_id || '-' || pair_no AS pair_id FROM p), o AS (SELECT *, row_number() OVER (ORDER BY {draw_sql(7, "pair_id")}, pair_id) - 1 AS i FROM k),
c AS (SELECT *, i // 2 AS couple, count(*) OVER (PARTITION BY i // 2) AS n, first_value(a) OVER w AS low, last_value(a) OVER w AS high FROM o
WINDOW w AS (PARTITION BY i // 2 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
s AS (SELECT *, n = 2 AND {uniform_sql(8, "couple")} < 0.5 AS swapped FROM c)
SELECT doc_id, pair_no::INT AS pair_no, CASE WHEN swapped THEN 0 ELSE 1 END AS consecutive, md5(CASE WHEN swapped AND i % 2 = 0 THEN high WHEN swapped THEN low ELSE a END) AS a, md5(b) AS b FROM s""")
def next_sentence_pairs(t):
    return next_sentences(t).select("doc_id", "pair_no", "consecutive", F.md5("a").alias("a"), F.md5("b").alias("b"))


@query("masked_instances", "D18 J11")
def masked_instances(t):
    pairs = next_sentences(t).select("pair_id", "consecutive", X.default_tokens(F.col("a")).alias("a"), X.default_tokens(F.col("b")).alias("b"))
    vocab = V.build_vocabulary(tokens(t), "tokens", 1, X.CODE_RESERVED, X.CODE_RESERVED[0], max_size=35000)
    size = vocab.count()
    ids = V.encode(pairs, "a", vocab, "pair_id", target="ia")
    ids = V.encode(ids, "b", vocab, "pair_id", target="ib")
    out = S.masked_instances(ids.select("pair_id", "consecutive", "ia", "ib"), "ia", "ib", "pair_id", 11, 1, 2, 3, size)
    names = ["token_ids", "type_ids", "input_mask", "masked_positions", "masked_ids", "label_mask"]
    return out.select(
        "pair_id", "consecutive", "length", *[X.join_tokens(F.col(n).cast("array<string>")).alias(n) for n in names]
    )


@query("corpus_shards", "D19", """
SELECT doc_id % 4 AS shard, count(*) AS docs, count(DISTINCT doc_id) AS distinct_docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1""")
def corpus_shards(t):
    """Four disjoint shards by key, as a worker reads its own; together they hold every document once."""
    shards = t.documents.withColumn("shard", F.pmod("doc_id", F.lit(4)))
    return shards.groupBy("shard").agg(
        F.count("*").alias("docs"), F.count_distinct("doc_id").alias("distinct_docs"), F.sum(F.length("text")).alias("chars")
    )


WORD_VECTORS = """vectors AS (SELECT token, id, embedding AS vector FROM vocab JOIN embeddings ON vec_id = id % (SELECT count(*) FROM embeddings))"""


def word_vectors(t, vocab):
    return vocab.withColumn("vec_id", F.col("id") % t.embeddings.count()).join(t.embeddings, "vec_id").select(
        "token", "id", F.col("embedding").cast("array<double>").alias("vector")
    )


@query("embedded_tokens", "J02 M11", f"""
WITH {TOKENS}, {VOCAB}, {WORD_VECTORS}, two AS (SELECT token, vector[1]::DOUBLE AS first, vector[64]::DOUBLE AS last FROM vectors)
SELECT doc_id, pos, coalesce(v.first, u.first) AS first, coalesce(v.last, u.last) AS last
FROM tok LEFT JOIN two v USING (token), (SELECT first, last FROM two WHERE token = '<unk>') u""")
def embedded_tokens(t):
    base = tokens(t)
    vectors = cut_lineage(word_vectors(t, vocabulary(base)))
    out = V.embed(base, "tokens", vectors, "doc_id")
    return out.select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.get("vector", F.lit(0)).alias("first"), F.element_at("vector", -1).alias("last")
    )


@query("sentence_embedding", "M06", f"""
WITH {TOKENS}, {VOCAB}, {WORD_VECTORS}, x AS (SELECT doc_id, coalesce(v.vector, u.vector) AS e
FROM tok LEFT JOIN vectors v USING (token), (SELECT vector FROM vectors WHERE token = '<unk>') u),
c AS (SELECT doc_id, unnest(e)::DOUBLE AS v, generate_subscripts(e, 1) - 1 AS dim FROM x)
SELECT doc_id, dim, round(avg(v), 6) + 0.0 AS value FROM c GROUP BY 1, 2""")
def sentence_embedding(t):
    base = tokens(t)
    vectors = cut_lineage(word_vectors(t, vocabulary(base)))
    out = V.mean_embedding(V.embed(base, "tokens", vectors, "doc_id", added=True), "doc_id")
    return out.select("doc_id", F.col("dim").cast("long").alias("dim"), r6("value").alias("value"))


@query("document_features", "D15 F30 D13 J01 D10 J09", f"""
WITH {TOKENS}, {VOCAB}, e AS (SELECT doc_id, pos, coalesce(id, 3) AS id FROM tok LEFT JOIN vocab USING (token)),
d AS (SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch_id FROM documents LEFT JOIN labels USING (doc_id)),
s AS (SELECT doc_id, batch_id, quality, toxic, count(pos) AS valid_length, coalesce(sum(id), 0)::BIGINT AS id_sum,
coalesce(sum(id * (pos + 1)), 0)::BIGINT AS id_check FROM d LEFT JOIN e USING (doc_id) GROUP BY ALL)
SELECT *, max(valid_length) OVER (PARTITION BY batch_id) AS width FROM s""")
def document_features(t):
    base = tokens(t)
    vocab = vocabulary(base)
    # Documents without a label stay, with -1.
    labelled = O.batches(base.join(t.labels, "doc_id", "left").fillna(-1, ["quality", "toxic"]), 32, "doc_id", wide=True)
    ids = V.encode(labelled, "tokens", vocab, "doc_id")
    out = B.pad_batches(ids, "ids", "batch_id", F.lit(2).cast("long"))

    def total(array, weight):
        return F.aggregate(F.transform(array, weight), F.lit(0).cast("long"), lambda s, x: s + x)

    return out.select(
        "doc_id", "batch_id", "quality", "toxic", F.col("valid_length").cast("long").alias("valid_length"),
        total("ids", lambda x, i: x).alias("id_sum"), total("ids", lambda x, i: x * (i + 1)).alias("id_check"),
        F.size("padded").cast("long").alias("width"),
    )
