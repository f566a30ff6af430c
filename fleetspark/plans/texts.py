"""Queries over documents, chunks and vectors."""

from pyspark.sql import functions as F

from ..checkpoints import materialised
from ..functions import chunk_id, rounded
from ..functions.vectors import embed_hashed, hashed_vector
from ..operators import chunking, dictionary, intent, inverted_file, lines, search
from . import answering
from .registry import Registry, shown

BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(133), chr(160), chr(8195), chr(12288))"

CHUNKS_SQL = f"""
    chunks AS (
        SELECT * FROM (
            SELECT doc_id, lang, place AS window_no, trim(substring(text, place * 500 + 1, 600), {BLANKS}) AS chunk
            FROM (SELECT *, unnest(range((length(text) + 499) // 500)) AS place FROM documents))
        WHERE length(chunk) >= 80)
"""

# The tags that hold after the text `earlier`.
TAGS_SQL = """CASE WHEN contains(earlier, 'SECTION 4') THEN 'General' WHEN contains(earlier, 'SECTION 3') THEN 'LONGi Solar'
                    WHEN contains(earlier, 'SECTION 2') THEN 'Siemens Gamesa' WHEN contains(earlier, 'SECTION 1') THEN 'Vestas'
                    ELSE 'Unknown' END AS manufacturer,
               CASE WHEN contains(earlier, 'SECTION 4') THEN 'All models' WHEN contains(earlier, 'SECTION 3') THEN 'Hi-MO 6'
                    WHEN contains(earlier, 'SECTION 2') THEN 'SG-6.6-170' WHEN contains(earlier, 'SECTION 1') THEN 'V150-4.5'
                    ELSE 'Unknown' END AS model"""

# The pieces of each manual from one fault header to the next, with all the text before each.
BLOCKS_SQL = rf"""
    cuts AS (SELECT doc_id, string_split(text, 'FAULT CODE: ') AS parts FROM manuals),
    pieces AS (SELECT doc_id, parts, unnest(range(1, len(parts))) AS position FROM cuts),
    blocks AS (
        SELECT doc_id, position, array_to_string(parts[1:position], 'FAULT CODE: ') AS earlier,
               trim(regexp_extract('FAULT CODE: ' || parts[position + 1], '(?sm)\A(.*?)(?:^-{{10,}}|\z)', 1), {BLANKS}) AS block
        FROM pieces),
    tagged AS (
        SELECT doc_id, position, regexp_extract(block, 'FAULT CODE: (E-\d+)', 1) AS fault_code,
               {TAGS_SQL}, block
        FROM blocks WHERE length(block) >= 50)
"""

SECTIONS_SQL = rf"""
    bodies AS (
        SELECT *, {TAGS_SQL} FROM (SELECT doc_id, substr(text, 1, strpos(text, 'PERFORMANCE OVERVIEW')) AS earlier, trim(regexp_extract(text, '(?sm)^(\d+\.\d+\s+PERFORMANCE OVERVIEW.*?)(?:^\d+\.\d+\s+[A-Z]|-{{10,}}|\z)', 1), {BLANKS}) AS body
        FROM manuals)),
    sections AS (SELECT doc_id, trim(string_split(body, chr(10))[1], {BLANKS}) AS section, manufacturer, model, body FROM bodies WHERE length(body) >= 100)
"""

MANUAL_SQL = f"""
    {BLOCKS_SQL}, {SECTIONS_SQL},
    windows AS (
        SELECT doc_id, section, manufacturer, model, trim(substring(body, place * 500 + 1, 600), {BLANKS}) AS chunk
        FROM (SELECT *, unnest(range((length(body) + 499) // 500)) AS place FROM sections)),
    contents AS (
        SELECT doc_id, concat('[OEM Manual | ', manufacturer, ' ', model, ']', chr(10), block) AS page_content, 'fault_code' AS chunk_type, fault_code,
               manufacturer, model, NULL AS section FROM tagged
        UNION ALL
        SELECT doc_id, concat('[OEM Manual | ', manufacturer, ' ', model, ']', chr(10), chunk), 'narrative', NULL, manufacturer, model, section
        FROM windows WHERE length(chunk) >= 80),
    manual_chunks AS (
        SELECT concat('manual_', replace(manufacturer, ' ', '_'), '_', coalesce(fault_code, 'overview'), '_', md5(page_content)) AS id, *
        FROM contents)
"""

DIMS = 256


def _vectors_sql(name: str, source: str, key: str, text: str) -> str:
    """SQL of hashed word counts as unit vectors in coordinate form (`{name}`: key, bucket, weight)."""
    return f"""
        {name}_words AS (
            SELECT {key}, unnest(string_split(trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')) AS word FROM {source}),
        {name}_counts AS (
            SELECT {key}, ('0x' || substr(md5(word), 1, 8))::BIGINT % {DIMS} AS bucket, count(*) AS n FROM {name}_words WHERE word <> '' GROUP BY ALL),
        {name} AS (
            SELECT {key}, bucket, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS weight FROM {name}_counts)
    """


def manual_index(t):
    """Chunks of the manuals, each id once, with vectors."""
    return embed_hashed(search.new_chunks(chunking.manual_chunks(t.manuals), None), DIMS)


def manual_queries(t):
    """Search questions with their filters and vectors."""
    asked = intent.with_search_filters(t.manual_questions)
    return asked.withColumn("embedding", hashed_vector(F.col("question"), DIMS))


def manual_hits(t):
    """The best chunks for every search question, from the stored index."""
    return search.top_k_search(materialised(manual_index(t)), manual_queries(t), 5, ("fault_code", "manufacturer"))


HITS_SQL = f"""
    {MANUAL_SQL},
    indexed AS (SELECT * FROM manual_chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id) = 1),
    {_vectors_sql("doc_vectors", "indexed", "id", "page_content")},
    {_vectors_sql("query_vectors", "manual_questions", "query_id", "question")},
    filters AS (
        SELECT query_id, nullif(upper(regexp_extract(question, '(?i)\\b(E-\\d+)\\b', 1)), '') AS fault_code,
               CASE WHEN contains(lower(question), 'vestas') THEN 'Vestas' WHEN regexp_matches(lower(question), 'siemens|gamesa') THEN 'Siemens Gamesa'
                    WHEN regexp_matches(lower(question), 'longi|hi-mo') THEN 'LONGi Solar' END AS manufacturer
        FROM manual_questions),
    dots AS (SELECT query_id, id, sum(q.weight * d.weight) AS dot FROM query_vectors q JOIN doc_vectors d ON q.bucket = d.bucket GROUP BY ALL),
    norms AS (SELECT id, sqrt(sum(weight * weight)) AS size FROM doc_vectors GROUP BY id),
    query_norms AS (SELECT query_id, sqrt(sum(weight * weight)) AS size FROM query_vectors GROUP BY query_id),
    scored AS (
        SELECT f.query_id, i.id, {shown("coalesce(dot / (n.size * qn.size), 0)", 4)} AS score
        FROM filters f JOIN indexed i ON (f.fault_code IS NULL OR i.fault_code = f.fault_code) AND (f.manufacturer IS NULL OR i.manufacturer = f.manufacturer)
        LEFT JOIN dots USING (query_id, id) LEFT JOIN norms n ON n.id = i.id LEFT JOIN query_norms qn ON qn.query_id = f.query_id),
    hits AS (
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM scored QUALIFY rank <= 5)
"""

CENTROIDS_SQL = """
    points AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS place FROM embeddings),
    centres AS (
        SELECT label, list(x ORDER BY place) AS embedding FROM (SELECT label, place, avg(x) AS x FROM points GROUP BY ALL) GROUP BY label)
"""


def centroid_queries(t):
    """One query per label: the mean vector of the label."""
    return search.label_centroids(t.raw("embeddings")).select(F.col("label").alias("query_id"), "label", "embedding")


def vectors(t):
    """The vector table in the shape of the search."""
    return t.raw("embeddings").withColumnRenamed("vec_id", "id")


def _filed_vectors(t):
    """The vector table as an inverted file."""
    return inverted_file.InvertedFile.write(vectors(t), t.folder("inverted"))


def _indexed_recall(t):
    """Every fiftieth vector searched in the inverted file, and whether at least 0.9 of the exact neighbours are found."""
    asked = t.raw("embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = _filed_vectors(t).search(asked, 5)
    measured = inverted_file.recall(found, search.top_k_search(vectors(t), asked, 5))
    return measured.select("queries", "neighbours", (F.col("recall") >= 0.9).alias("enough"))


def _answered(t):
    """Answers that cite the second and the fifth hit of each search question, and one that is not there."""
    return t.manual_questions.select("query_id", F.lit("as told in [Source 2], [Source 5] and [Source 9]").alias("answer"))


def _hit_rows(t, *columns: str):
    """The hits with the given columns of their chunks. The index is stored, as it is read for the search and the texts."""
    index = materialised(manual_index(t))
    hits = search.top_k_search(index, manual_queries(t), 5, ("fault_code", "manufacturer"))
    return search.with_content(hits, index, columns)


def register(registry: Registry) -> None:
    """Add the text and vector queries."""
    registry.add(
        "chunk_documents",
        lambda t: chunking.window_chunks(t.raw("documents").select("doc_id", "text")),
        f"WITH {CHUNKS_SQL} SELECT doc_id, window_no, chunk FROM chunks",
    )
    registry.add(
        "segment_blocks",
        lambda t: chunking.fault_blocks(t.manuals),
        f"WITH {BLOCKS_SQL} SELECT * FROM tagged",
        "manuals",
    )
    registry.add(
        "segment_blocks_of_lines",
        lambda t: lines.fault_blocks_of_lines(lines.lines_of(t.manuals)).withColumn("position", F.col("position").cast("bigint")),
        f"WITH {BLOCKS_SQL} SELECT * FROM tagged",
        "manuals",
    )
    registry.add(
        "narrative_sections",
        lambda t: chunking.narrative_sections(t.manuals).drop("position"),
        f"WITH {SECTIONS_SQL} SELECT * FROM sections",
        "manuals",
    )
    registry.add(
        "manual_chunks",
        lambda t: chunking.manual_chunks(t.manuals).drop("doc_type"),
        f"WITH {MANUAL_SQL} SELECT * FROM manual_chunks",
        "manuals",
    )
    registry.add(
        "chunk_counts",
        lambda t: chunking.chunk_counts(chunking.manual_chunks(t.manuals)),
        f"WITH {MANUAL_SQL} SELECT chunk_type, count(*) AS chunk_count FROM manual_chunks GROUP BY ALL",
        "manuals",
    )
    registry.add(
        "manual_headings",
        lambda t: chunking.headings(t.manuals),
        r"""SELECT doc_id, 'fault_code' AS kind, unnest(regexp_extract_all(text, 'FAULT CODE: (E-\d+)', 1)) AS value FROM manuals
            UNION ALL SELECT doc_id, 'section', unnest(regexp_extract_all(text, '(SECTION \d+)', 1)) FROM manuals""",
        "manuals",
    )

    opening = r"regexp_extract(text, '^[^ ]+ [^ ]+', 0)"
    registry.add(
        "phrases_from_table",
        lambda t: dictionary.phrase_matches(
            t.raw("documents"), t.raw("documents").select(F.expr(opening).alias("phrase")), "doc_id"
        ),
        f"""WITH phrases AS (SELECT DISTINCT phrase FROM (SELECT {opening} AS phrase FROM documents) WHERE phrase <> '')
            SELECT doc_id, phrase FROM documents JOIN phrases ON contains(lower(text), lower(phrase))""",
    )
    registry.add(
        "locations_from_table",
        lambda t: dictionary.first_named(
            t.questions, t.question_assets.groupBy(F.col("location").alias("phrase")).agg(F.min("asset_id").alias("place"))
        ).select("request_id", "named"),
        """WITH names AS (SELECT location, min(asset_id) AS place FROM question_assets GROUP BY location)
            SELECT request_id, arg_min(location, place) AS named FROM questions
            LEFT JOIN names ON contains(lower(question), lower(location)) GROUP BY request_id""",
        "questions question_assets",
    )

    def document_chunks(t):
        chunks = chunking.window_chunks(t.raw("documents").select("doc_id", "lang", "text"))
        return chunks.withColumn("id", chunk_id(F.col("lang"), F.lit(None).cast("string"), F.col("chunk")))

    registry.add(
        "incremental_index",
        lambda t: search.new_chunks(document_chunks(t), document_chunks(t).filter("lang = 'en'")).select("id", "chunk"),
        f"""WITH {CHUNKS_SQL}, ided AS (SELECT *, concat('manual_', lang, '_overview_', md5(chunk)) AS id FROM chunks)
            SELECT id, min(chunk) AS chunk FROM ided WHERE id NOT IN (SELECT id FROM ided WHERE lang = 'en') GROUP BY id""",
    )
    registry.add(
        "hashed_vectors",
        lambda t: t.raw("benchmark")
        .select("item_id", F.posexplode(hashed_vector(F.col("text"), DIMS)).alias("bucket", "weight"))
        .filter("weight > 0")
        .select("item_id", F.col("bucket").cast("bigint").alias("bucket"), rounded(F.col("weight").cast("double"), 6).alias("weight")),
        f"""WITH {_vectors_sql("hashed", "benchmark", "item_id", "text")} SELECT item_id, bucket, {shown("weight", 6)} AS weight FROM hashed""",
    )
    cosine_sql = "list_cosine_similarity(e.embedding::DOUBLE[], c.embedding)"
    ranked = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank"
    registry.add(
        "knn_topk",
        lambda t: search.top_k_search(vectors(t), centroid_queries(t), 5),
        f"""WITH {CENTROIDS_SQL}, scored AS (
                SELECT c.label AS query_id, vec_id AS id, {shown(cosine_sql, 4)} AS score FROM centres c, embeddings e)
            SELECT query_id, {ranked}, id, score FROM scored QUALIFY rank <= 5""",
    )
    registry.add(
        "knn_filtered",
        lambda t: search.top_k_search(vectors(t), centroid_queries(t), 5, ("label",)),
        f"""WITH {CENTROIDS_SQL}, scored AS (
                SELECT c.label AS query_id, vec_id AS id, {shown(cosine_sql, 4)} AS score FROM centres c JOIN embeddings e ON c.label = e.label)
            SELECT query_id, {ranked}, id, score FROM scored QUALIFY rank <= 5""",
    )
    registry.add(
        "knn_indexed_all",
        lambda t: _filed_vectors(t).search(centroid_queries(t), 5, inverted_file.CELLS),
        f"""WITH {CENTROIDS_SQL}, scored AS (
                SELECT c.label AS query_id, vec_id AS id, {shown(cosine_sql, 4)} AS score FROM centres c, embeddings e)
            SELECT query_id, {ranked}, id, score FROM scored QUALIFY rank <= 5""",
    )
    registry.add(
        "knn_indexed",
        _indexed_recall,
        """SELECT count(*) AS queries, count(*) * least(5, (SELECT count(*) FROM embeddings)) AS neighbours, true AS enough
            FROM embeddings WHERE vec_id % 50 = 0""",
    )
    registry.add(
        "relevance_gate",
        lambda t: search.relevance_gate(
            centroid_queries(t), search.top_k_search(vectors(t), centroid_queries(t), 5), min_score=0.55
        ),
        f"""WITH {CENTROIDS_SQL}, best AS (
                SELECT c.label AS query_id, max({shown(cosine_sql, 4)}) AS best_score FROM centres c, embeddings e GROUP BY ALL)
            SELECT query_id, best_score, CASE WHEN best_score < 0.55 THEN 'low relevance' END AS error, best_score >= 0.55 AS passed FROM best""",
    )
    registry.add(
        "cosine_to_centroid",
        lambda t: t.raw("embeddings")
        .alias("e")
        .join(search.label_centroids(t.raw("embeddings")).alias("c"), "label")
        .select("vec_id", rounded(search.cosine(F.col("e.embedding"), F.col("c.embedding")), 4).alias("score")),
        f"""WITH {CENTROIDS_SQL} SELECT vec_id, {shown(cosine_sql, 4)} AS score FROM embeddings e JOIN centres c ON e.label = c.label""",
    )
    registry.add(
        "manual_search",
        manual_hits,
        f"WITH {HITS_SQL} SELECT * FROM hits",
        "manuals manual_questions",
    )
    registry.add(
        "manual_results",
        lambda t: answering.manual_results(
            t.manual_questions.withColumnRenamed("query_id", "request_id"),
            materialised(manual_index(t)),
            lambda asked: asked.withColumn("embedding", hashed_vector(F.col("question"), DIMS)),
            min_score=0.4,
        ).select(
            "request_id",
            "status",
            "error",
            F.get_json_object("data_json", "$.chunks_used").cast("bigint").alias("chunks_used"),
            F.get_json_object("data_json", "$.context").alias("context"),
        ),
        f"""WITH {HITS_SQL}, packed AS (
                SELECT query_id, count(*) AS chunks_used, max(score) AS best, string_agg(concat('[Source ', rank, '] OEM Manual | ', manufacturer, ' ', model, ' | ',
                    coalesce(fault_code, 'overview'), ' (', chunk_type, ')', chr(10), page_content, chr(10)), concat(chr(10), '---', chr(10)) ORDER BY rank) AS context
                FROM hits JOIN indexed USING (id) GROUP BY query_id)
            SELECT q.query_id AS request_id, CASE WHEN best >= 0.4 THEN 'ok' ELSE 'error' END AS status,
                CASE WHEN best IS NULL THEN 'no documents retrieved' WHEN best < 0.4 THEN 'low relevance' END AS error,
                CASE WHEN best >= 0.4 THEN chunks_used END AS chunks_used, CASE WHEN best >= 0.4 THEN context END AS context
            FROM manual_questions q LEFT JOIN packed p ON q.query_id = p.query_id""",
        "manuals manual_questions",
    )
    registry.add(
        "context_pack",
        lambda t: search.numbered_context(
            _hit_rows(t, "page_content", "chunk_type", "fault_code", "manufacturer", "model"),
            search.source_label(F.col("fault_code"), F.col("manufacturer"), F.col("model"), F.col("chunk_type")),
        ),
        f"""WITH {HITS_SQL}, packed AS (
                SELECT query_id, rank, score, concat('[Source ', rank, '] OEM Manual | ', manufacturer, ' ', model, ' | ', coalesce(fault_code, 'overview'), ' (', chunk_type, ')',
                    chr(10), page_content, chr(10)) AS block
                FROM hits JOIN indexed USING (id))
            SELECT query_id, string_agg(block, concat(chr(10), '---', chr(10)) ORDER BY rank) AS context, count(*) AS chunks_used, max(score) AS best_score FROM packed GROUP BY query_id""",
        "manuals manual_questions",
    )
    registry.add(
        "cited_chunks",
        lambda t: search.cited_chunks(
            _answered(t),
            _hit_rows(t, "page_content", "fault_code", "manufacturer", "model"),
        ).drop("page_content"),
        f"""WITH {HITS_SQL} SELECT query_id, rank, id, score, fault_code, manufacturer, model, substring(page_content, 1, 200) || '...' AS snippet
            FROM hits JOIN indexed USING (id) WHERE rank IN (2, 5)""",
        "manuals manual_questions",
    )
