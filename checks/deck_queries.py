"""Deck corpus, slide context, prompts, generation hooks and quizzes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs
from checks.deck_files import deck_files
from checks.registry import flat_messages, query
from checks.sqltext import WS, clean, quoted, with_inputs
from lectern.functions import fixed, prompts
from lectern.functions.text import concept_topic, topic_of
from lectern.operators import context, decks, hooks, quiz
from lectern.plans import explain
from lectern.session import fresh_path, scratch
from lectern.sources.decks import Decks, export_images, ingest_decks, parse_decks, read_decks, stage_decks, staged_rows, stored_sizes

# --- decks ---------------------------------------------------------------------------

TABLE = "array_to_string([source || '/' , lang || '/' || n_chars], ';')"


def _tables() -> Column:
    rows = F.transform("tables", lambda t: F.array_join(F.transform(t, lambda r: F.array_join(r, "/")), ";"))
    return F.array_join(rows, "#").alias("tables")


SLIDES = f"""
    SELECT deck, slide_number, text_content, CASE WHEN has_table THEN {TABLE} ELSE '' END AS tables, notes,
           len(string_split(text, chr(10))) AS shapes,
           'line 0=' || string_split(text, chr(10))[1] || '=TEXT_BOX (17)' AS first_shape
    FROM slides JOIN (SELECT doc_id, text FROM documents) USING (doc_id)"""


def _slide_columns(rows: DataFrame) -> DataFrame:
    first = F.get("shape_details", F.lit(0))
    return decks.finish_slides(rows).select(
        "deck",
        "slide_number",
        "text_content",
        _tables(),
        "notes",
        F.size("shape_details").alias("shapes"),
        F.concat_ws("=", first["shape_name"], first["text"], first["shape_type"]).alias("first_shape"),
    )


@query("slide_text_tables_notes", with_inputs("slides", SLIDES))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _slide_columns(inputs.deck_rows(spark, folder))


@query(
    "deck_shapes",
    """SELECT 'deck' || (doc_id // 12) AS deck, doc_id % 12 + 1 AS slide_number, i - 1 AS ordinal,
              'line ' || (i - 1) AS shape_name, 'TEXT_BOX (17)' AS shape_type, lines[i] AS text
       FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
             FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return decks.shape_rows(inputs.deck_rows(spark, folder))


@query("deck_ingest_slides", with_inputs("slides", SLIDES), workers=True)
def _(spark: SparkSession, folder: str) -> DataFrame:
    """The documents packed into deck files and read back from their bytes."""
    return _slide_columns(parse_decks(deck_files(spark, folder)))


@query(
    "deck_ingest_images",
    """WITH p AS (SELECT 'deck' || (doc_id // 12) AS deck, doc_id % 12 + 1 AS slide_number, doc_id,
                      octet_length(encode(text)) AS width, doc_id % 500 + 1 AS height, lang,
                      CASE WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id // 3 % 2 = 0 THEN 'png' ELSE 'jpg' END
                           ELSE CASE WHEN doc_id // 3 % 2 = 0 THEN 'gif' ELSE 'bmp' END END AS image_format
               FROM documents WHERE doc_id % 3 > 0)
       SELECT deck, slide_number, 'picture' AS shape_name, image_format,
              CASE WHEN image_format IN ('png', 'bmp') THEN width ELSE width % 65536 END AS width, height,
              min(slide_number) OVER (PARTITION BY deck, image_format, width, height, lang) AS stored_with
       FROM p""",
    workers=True,
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    images = stage_decks(deck_files(spark, folder)).images
    return decks.image_dimensions(images).select(
        "deck",
        "slide_number",
        "shape_name",
        "image_format",
        "dimensions.width",
        "dimensions.height",
        F.regexp_extract("image_path", "^slide([0-9]+)_", 1).cast("long").alias("stored_with"),
    )


@query(
    "deck_ingest_documents",
    """SELECT 'deck' || (doc_id // 12) AS deck, doc_id % 12 + 1 AS slide_number,
              CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS images,
              CASE WHEN doc_id % 3 > 0 THEN doc_id % 500 + 1 END AS height FROM documents""",
    workers=True,
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    """Slides with their images nested, as they come from the file."""
    slides = stage_decks(deck_files(spark, folder)).slides
    first = F.get("images", F.lit(0))
    return slides.select(
        "deck",
        "slide_number",
        F.size("images").alias("images"),
        first["dimensions"]["height"].alias("height"),
    )


@query(
    "deck_ingest_errors",
    """SELECT 'deck' || (doc_id // 12) || '-cut' AS deck, error
       FROM documents, (VALUES ('text_extraction_failed'), ('image_extraction_failed')) e(error)
       WHERE doc_id % 12 = 0""",
    workers=True,
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    """Each deck file beside a cut-off copy of itself: the copies go to quarantine."""
    files = deck_files(spark, folder)
    cut = files.select(
        F.concat("path", F.lit("-cut")).alias("path"),
        F.expr("substring(content, 1, length(content) - 30)").alias("content"),
    )
    failed = decks.quarantine(parse_decks(files.unionByName(cut)))
    return failed.select("deck", F.split_part("error", F.lit(":"), F.lit(1)).alias("error"))


DECK_FILES = """SELECT 'deck' || (doc_id // 12) || CASE WHEN doc_id // 12 % 2 = 0 THEN '.pptx' ELSE '.PPTX' END AS deck,
              count(*) AS total_slides, count(*) FILTER (WHERE doc_id % 3 > 0) AS total_images
       FROM documents GROUP BY doc_id // 12"""


def _deck_folder(spark: SparkSession, folder: str) -> str:
    """Decks as files in a folder, every second with an upper-case suffix, beside files that are
    no decks."""
    files = deck_files(spark, folder)
    even = F.regexp_extract("path", "([0-9]+)$", 1).cast("int") % 2 == 0
    names = F.array(F.concat("path", F.when(even, ".pptx").otherwise(".PPTX")), F.concat("path", F.lit(".txt")))
    named = files.select(F.col("path").alias("deck"), F.explode(names).alias("image_path"), "content")
    out = fresh_path(spark, "deck-files")
    export_images(named, out)
    return out


def _deck_counts(read: Decks) -> DataFrame:
    summary = decks.deck_summary(read.slides, read.images)
    return summary.select(F.regexp_extract("deck", "([^/]+)$", 1).alias("deck"), "total_slides", "total_images")


@query("read_deck_files", DECK_FILES, workers=True)
def _(spark: SparkSession, folder: str) -> DataFrame:
    """What is read from a folder of files."""
    return _deck_counts(ingest_decks(spark, _deck_folder(spark, folder)))


@query("read_deck_files_in_shares", DECK_FILES, workers=True)
def _(spark: SparkSession, folder: str) -> DataFrame:
    """The same with nearly every file cut into shares, as large ones are."""
    with scratch(spark):
        staged = staged_rows(read_decks(spark, _deck_folder(spark, folder), piece_bytes=10_000))
    return _deck_counts(staged)


STORED_PATH = "printf('slide%03d_%s.png', first_slide, sha1)"


@query(
    "dedup_images",
    with_inputs(
        "stored",
        f"""SELECT d.lang AS deck, d.doc_id + 1 AS slide_number, s.sha1, {STORED_PATH} AS image_path
            FROM documents d JOIN stored s ON s.deck = d.lang AND s.sha1 = sha1(d.text)""",
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    images = decks.with_sha1(inputs.lang_images(spark, folder))
    return decks.dedup_images(images).select("deck", "slide_number", "sha1", "image_path")


@query(
    "image_blobs",
    with_inputs(
        "stored",
        f"""SELECT deck, sha1, {STORED_PATH} AS image_path, (SELECT any_value(text) FROM documents d
                   WHERE d.lang = s.deck AND sha1(d.text) = s.sha1) AS content FROM stored s""",
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    blobs = decks.image_blobs(decks.with_sha1(inputs.lang_images(spark, folder)))
    return blobs.withColumn("content", F.col("content").cast("string"))


@query(
    "attach_images",
    with_inputs(
        "slides images",
        """SELECT s.deck, s.slide_number, s.text_content, CAST(i.ordinal AS BIGINT) AS ordinal, i.image_path
           FROM slides s LEFT JOIN images i ON i.deck = s.deck AND i.slide_number = s.slide_number""",
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    merged = decks.attach_images(inputs.slides(spark, folder), inputs.deck_images(spark, folder))
    return merged.select(
        "deck", "slide_number", "text_content", "image.ordinal", "image.image_path"
    )


@query(
    "image_gallery",
    with_inputs(
        "images",
        "SELECT deck, slide_number, CAST(ordinal AS BIGINT) AS ordinal, image_path FROM images WHERE image_path <> ''",
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return decks.gallery(inputs.deck_images(spark, folder))


@query(
    "deck_summary",
    with_inputs(
        "slides images",
        """SELECT deck, total_slides, total_images,
                  'Processed ' || total_slides || ' slides. Found ' || shown || ' images.' AS status
           FROM (SELECT deck, count(*) AS total_slides FROM slides GROUP BY deck)
           JOIN (SELECT s.deck, count(i.deck) AS total_images, count(NULLIF(i.image_path, '')) AS shown FROM (SELECT DISTINCT deck FROM slides) s
                 LEFT JOIN images i ON i.deck = s.deck GROUP BY s.deck) USING (deck)""",
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return decks.deck_summary(inputs.slides(spark, folder), inputs.deck_images(spark, folder))


def _cut(expr: str, n: int, empty: str) -> str:
    text = clean(expr)
    return (
        f"CASE WHEN {text} = '' THEN '{empty}' WHEN length({text}) > {n} "
        f"THEN left({text}, {n}) || '...' ELSE {text} END"
    )


@query(
    "slide_cards",
    with_inputs(
        "slides images",
        f"""SELECT r.deck, r.slide_idx, coalesce(card, 'No slide data available') AS card
            FROM (SELECT 'deck' || (doc_id // 12) AS deck, doc_id % 14 - 1 AS slide_idx FROM documents) r
            LEFT JOIN (SELECT s.deck, s.slide_number - 1 AS slide_idx,
                '**Slide ' || s.slide_number || '**' || chr(10) || chr(10) || 'Text: ' || {_cut('text_content', 500, '(no text)')}
                || chr(10) || chr(10) || 'Tables: ' || CASE WHEN has_table THEN 1 ELSE 0 END || ' table(s)'
                || chr(10) || chr(10) || 'Images: ' || coalesce(n, 0) || ' image(s)'
                || chr(10) || chr(10) || 'Notes: ' || {_cut('notes', 200, '(no notes)')} AS card
              FROM slides s LEFT JOIN (SELECT deck, slide_number, count(*) AS n FROM images GROUP BY ALL) i
                   ON i.deck = s.deck AND i.slide_number = s.slide_number) c
            ON c.deck = r.deck AND c.slide_idx = r.slide_idx""",
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    requests = inputs.table(spark, folder, "documents").select(
        inputs.deck_name().alias("deck"), (F.col("doc_id") % 14 - 1).alias("slide_idx")
    )
    return decks.slide_card(
        inputs.slides(spark, folder), inputs.deck_images(spark, folder), requests
    )


# --- context and prompts -------------------------------------------------------------

INDICES = [7, 0, 0, -1, 1, 2, 30]


@query(
    "select_slides",
    with_inputs(
        "slides",
        """SELECT 'first' AS rule, deck, slide_number - 1 AS position, slide_number FROM slides WHERE slide_number <= 5
           UNION ALL
           SELECT 'listed', deck, pos, slide_number FROM slides
           JOIN (VALUES (0, 7), (1, 0), (2, 0), (3, -1), (4, 1)) l(pos, idx) ON idx = slide_number - 1""",
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    slides = inputs.slides(spark, folder).select("deck", "slide_number")
    first = context.select_slides(slides).withColumn("rule", F.lit("first"))
    listed = context.select_slides(slides, INDICES).withColumn("rule", F.lit("listed"))
    return first.unionByName(listed)


NL = "chr(10)"


def _block(image_lines: str = "NULL") -> str:
    return f"""array_to_string([x FOR x IN [
        '--- Slide ' || slide_number || ' ---',
        CASE WHEN text_content <> '' THEN 'Text: ' || text_content END,
        CASE WHEN has_table THEN 'Tables: | ' || source || ' |  |' END,
        CASE WHEN has_table THEN '| ' || lang || ' | ' || n_chars || ' |' END,
        CASE WHEN notes IS NOT NULL THEN 'Speaker Notes: ' || notes END,
        {image_lines}] IF x IS NOT NULL], {NL})"""


POSITIONS = {
    "first": "(SELECT slide_number - 1 AS pos, s.* FROM slides s WHERE slide_number <= 5)",
    "listed": "(SELECT pos, s.* FROM slides s JOIN (VALUES (0, 7), (1, 0), (2, 0), (3, -1), (4, 1)) l(pos, idx) ON idx = slide_number - 1)",
}
CAPTIONED = f"""(SELECT string_agg('Image: ' || 'caption of ' || image_path, {NL} ORDER BY ordinal)
    FROM images i WHERE i.deck = t.deck AND i.slide_number = t.slide_number AND i.image_path <> '')"""


def _contexts(rule: str, image_lines: str = "NULL") -> str:
    return f"""SELECT deck, trim(string_agg(block, {NL} || {NL} ORDER BY pos), {WS}) AS slide_context,
                      count(*) AS slides_in_context
               FROM (SELECT deck, pos, {_block(image_lines)} AS block FROM {POSITIONS[rule]} t) GROUP BY deck"""


@query("slide_context", with_inputs("slides", _contexts("listed")))
def _(spark: SparkSession, folder: str) -> DataFrame:
    selected = context.select_slides(inputs.slides(spark, folder), INDICES)
    return context.slide_context(selected)


def _stub_captioner():
    return lambda paths: [f"caption of {p}" for p in paths]


@query(
    "captioned_slide_context",
    with_inputs("slides images", _contexts("first", CAPTIONED)),
    workers=True,
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    images = inputs.deck_images(spark, folder).filter(context.in_context())
    captioned = hooks.caption_images(images, _stub_captioner)
    return context.slide_context(
        context.select_slides(inputs.slides(spark, folder)), captioned
    )


@query(
    "caption_images",
    with_inputs(
        "images",
        """SELECT deck, slide_number, CAST(ordinal AS BIGINT) AS ordinal, image_path,
                  CASE WHEN image_path LIKE '%0-1' THEN '[Image description unavailable]'
                       WHEN image_path <> '' THEN 'caption of ' || image_path END AS caption FROM images""",
    ),
    workers=True,
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    def make():
        def caption(paths):
            if any(p.endswith("0-1") for p in paths):
                raise ValueError("unreadable")
            return [f"caption of {p}" for p in paths]

        return caption

    return hooks.caption_images(inputs.deck_images(spark, folder), make)


@query(
    "captions_from_memo",
    with_inputs(
        "images",
        """SELECT deck, slide_number, CAST(ordinal AS BIGINT) AS ordinal,
                  CASE WHEN image_path <> '' AND image_path IN (SELECT image_path FROM images WHERE slide_number % 2 = 0 AND image_path NOT LIKE '%0-1')
                       THEN 'caption of ' || image_path WHEN image_path <> '' THEN 'late caption of ' || image_path END AS caption
           FROM images""",
    ),
    workers=True,
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the slides captioned, some in vain; then all, of which only unknown pictures are
    sent."""

    def first():
        def caption(paths):
            if any(p.endswith("0-1") for p in paths):
                raise ValueError("unreadable")
            return [f"caption of {p}" for p in paths]

        return caption

    images, memo = inputs.deck_images(spark, folder), fresh_path(spark, "memo")
    hooks.caption_images(images.filter("slide_number % 2 = 0"), first, memo=memo)
    late = hooks.caption_images(images, lambda: lambda paths: [f"late caption of {p}" for p in paths], memo=memo)
    return late.select("deck", "slide_number", "ordinal", "caption")


@query(
    "caption_ingested_pictures",
    """SELECT 'deck' || (doc_id // 12) AS deck, doc_id % 12 + 1 AS slide_number,
              'picture of ' || (octet_length(encode(lang)) + CASE doc_id % 3 - 1 + doc_id // 3 % 2 * 2 WHEN 0 THEN 24 WHEN 1 THEN 10 WHEN 2 THEN 45 ELSE 26 END)
              || ' bytes' AS caption,
              octet_length(encode(lang)) + CASE doc_id % 3 - 1 + doc_id // 3 % 2 * 2 WHEN 0 THEN 24 WHEN 1 THEN 10 WHEN 2 THEN 45 ELSE 26 END AS file_bytes
       FROM documents WHERE doc_id % 3 > 0""",
    workers=True,
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    """Pictures of deck files, captioned by their bytes and written as files."""

    def make():
        return lambda pictures: [f"picture of {len(content)} bytes" for _, content in pictures]

    staged = stage_decks(deck_files(spark, folder))
    captioned = hooks.caption_images(staged.images, make, blobs=staged.blobs)
    out = fresh_path(spark, "pictures")
    files = export_images(staged.blobs, out)
    written = stored_sizes(files, out).select("deck", "image_path", "file_bytes")
    return captioned.join(written, ["deck", "image_path"]).select("deck", "slide_number", "caption", "file_bytes")


def _topic(text: str) -> str:
    return f"""CASE WHEN {text} = '' THEN 'Concept from presentation' WHEN length({text}) <= 50 THEN {text}
        WHEN strpos({text}, '.') BETWEEN 2 AND 100 THEN left({text}, strpos({text}, '.')) ELSE left({text}, 100) END"""


@query("topic", f"SELECT doc_id, {_topic(clean('text'))} AS topic FROM documents")
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.table(spark, folder, "documents")
    return docs.select("doc_id", topic_of("text").alias("topic"))


DECK_TOPIC = f"""
    SELECT deck, {_topic('text_content')} AS topic FROM slides s
    WHERE slide_number = (SELECT max(slide_number) FROM slides t WHERE t.deck = s.deck AND t.slide_number <= 8)"""


@query("deck_topic", with_inputs("slides", DECK_TOPIC))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return context.deck_topic(inputs.slides(spark, folder), INDICES)


# An empty topic counts as none.
FIRST_SENTENCE = f"coalesce(NULLIF(trim(split_part(text, '.', 1), {WS}), ''), 'Concept')"
CONCEPT = f"""CASE WHEN doc_id % 3 = 1 THEN source
    ELSE {FIRST_SENTENCE} END"""


def _concepts(spark: SparkSession, folder: str) -> DataFrame:
    given = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("source"))
    docs = inputs.table(spark, folder, "documents")
    return docs.select("doc_id", "text", concept_topic("text", given).alias("topic"))


@query("concept_topic", f"SELECT doc_id, {CONCEPT} AS topic FROM documents")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _concepts(spark, folder).drop("text")


def _prompt(kind: str, note: str = "") -> str:
    template = (prompts.KINDS[kind] + note).replace("{num_questions}", "3")
    before, rest = template.split("{topic}")
    middle, after = rest.split("{text}")
    return f"{quoted(before)} || topic || {quoted(middle)} || text || {quoted(after)}"


KIND_PROMPTS = " UNION ALL ".join(
    f"""SELECT doc_id, '{kind}' AS kind, 'system=' || {quoted(fixed.SYSTEM_TEXT)} || '|user=' || {_prompt(kind)} AS messages
        FROM (SELECT doc_id, text, {CONCEPT} AS topic FROM documents)"""
    for kind in prompts.KINDS
)


@query("render_prompts", KIND_PROMPTS)
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = _concepts(spark, folder)
    kinds = [
        context.render_prompts(rows, kind).select(
            "doc_id", F.lit(kind).alias("kind"), flat_messages().alias("messages")
        )
        for kind in prompts.KINDS
    ]
    out = kinds[0]
    for df in kinds[1:]:
        out = out.unionByName(df)
    return out


STYLE_PROMPTS = {
    "comprehensive": _prompt("explanation"),
    "eli5": _prompt("explanation", prompts.STYLE_NOTES["eli5"]),
    "step_by_step": _prompt("step_by_step"),
    "feynman": _prompt("explanation", prompts.STYLE_NOTES["feynman"]),
}


@query(
    "style_prompts",
    "SELECT doc_id, style, 'system=' || "
    + quoted(fixed.SYSTEM_TEXT)
    + " || '|user=' || CASE style "
    + " ".join(f"WHEN '{s}' THEN {p}" for s, p in STYLE_PROMPTS.items())
    + f""" END AS messages
    FROM (SELECT doc_id, text, {CONCEPT} AS topic, unnest(['comprehensive', 'eli5', 'step_by_step', 'feynman']) AS style
          FROM documents)""",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    styled = context.all_styles(_concepts(spark, folder))
    return styled.select("doc_id", "style", flat_messages().alias("messages"))


@query(
    "requested_style",
    f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'eli5' WHEN 1 THEN 'step_by_step' ELSE 'comprehensive' END AS style
        FROM documents""",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    asked = inputs.pick(F.col("doc_id"), ("ELI5", "Step_By_Step", "poem", ""))
    return context.style_prompts(_concepts(spark, folder), asked).select("doc_id", "style")


CHATML = """list_transform(messages, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10))"""


@query(
    "render_chat",
    with_inputs(
        "chat",
        f"SELECT key, array_to_string({CHATML}, '') || '<|im_start|>assistant' || chr(10) AS prompt FROM chat",
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return context.render_chat(inputs.chat(spark, folder), True).select("key", "prompt")


# --- generation ----------------------------------------------------------------------


def _stub_generator():
    """Echoes the prompt's length and the settings; one kind of prompt fails."""

    def run(requests):
        if any("src13" in r["prompt"] for r in requests):
            raise ValueError("prompt refused")
        return [
            f"  {len(r['prompt'])} chars, {r['max_new_tokens']} tokens END {r['temperature']}"
            for r in requests
        ]

    return run


@query(
    "generate",
    """SELECT doc_id, CASE WHEN p NOT LIKE '%src13%' THEN length(p) || ' chars, ' || (100 + doc_id % 3) || ' tokens' END AS generated,
              CASE WHEN p LIKE '%src13%' THEN 'prompt refused' END AS error
       FROM (SELECT doc_id, '<|im_start|>user' || chr(10) || source || ': ' || text || '<|im_end|>' || chr(10)
                            || '<|im_start|>assistant' || chr(10) AS p FROM documents)""",
    workers=True,
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.table(spark, folder, "documents")
    turns = docs.withColumn(
        "messages", hooks.text_as_messages(F.concat("source", F.lit(": "), "text"))
    )
    done = hooks.generate(
        turns, _stub_generator, (100 + F.col("doc_id") % 3), stops=["STOP", "END"]
    )
    return done.select("doc_id", "generated", "error")


def _request_length(prompt: str) -> str:
    system = "<|im_start|>system\n" + fixed.SYSTEM_TEXT + "<|im_end|>\n<|im_start|>user\n"
    tail = "<|im_end|>\n<|im_start|>assistant\n"
    return f"length({quoted(system)} || {prompt} || {quoted(tail)})"


EXPLAINED = f"""
    SELECT d.deck, coalesce(slides_in_context, 0) AS slides_in_context, '7,0,0,-1,1,2,30' AS slides_used,
           coalesce(CASE WHEN NOT refused THEN topic END, '') AS topic,
           coalesce(CASE WHEN NOT refused THEN n || ' chars, 512 tokens END 0.7' END, '') AS explanation,
           CASE WHEN refused IS NULL THEN 'No slides found in slides_data' WHEN refused THEN 'prompt refused' END AS error
    FROM (SELECT DISTINCT deck FROM slides UNION ALL SELECT 'no such deck') d
    LEFT JOIN (SELECT deck, topic, slides_in_context, {_request_length(_prompt('explanation'))} AS n,
                      ({_prompt('explanation')}) LIKE '%src13%' AS refused
               FROM (SELECT t.deck, t.topic, coalesce(c.slide_context, '') AS text, coalesce(c.slides_in_context, 0) AS slides_in_context
                     FROM ({DECK_TOPIC}) t LEFT JOIN ({_contexts('listed', CAPTIONED)}) c ON c.deck = t.deck)) e
    ON e.deck = d.deck"""


@query("explain_batch", with_inputs("slides images", EXPLAINED), workers=True)
def _(spark: SparkSession, folder: str) -> DataFrame:
    slides = inputs.slides(spark, folder)
    names = slides.select("deck").distinct()
    none = names.limit(1).select(F.lit("no such deck").alias("deck"))
    done = explain.explain_batch(
        names.unionByName(none),
        slides,
        _stub_generator,
        INDICES,
        inputs.deck_images(spark, folder),
        _stub_captioner,
    )
    return done.select(
        "deck",
        "slides_in_context",
        F.array_join("slides_used", ",").alias("slides_used"),
        "topic",
        "explanation",
        "error",
    )


def _derived(kind: str, column: str, tokens: int) -> str:
    """A refused prompt keeps the caller's topic ('' without one) and has no settings."""
    return f"""SELECT doc_id, CASE WHEN refused THEN coalesce(source, '') ELSE topic END AS topic,
          CASE WHEN refused THEN '' ELSE {_request_length(_prompt(kind))} || ' chars, {tokens} tokens END 0.7' END AS {column},
          CASE WHEN NOT refused THEN CAST(0.7 AS DOUBLE) END AS temperature,
          CASE WHEN NOT refused THEN CAST({tokens} AS BIGINT) END AS max_tokens,
          CASE WHEN refused THEN 'prompt refused' END AS error
        FROM (SELECT doc_id, text, source, topic, text LIKE '%src13%' OR topic LIKE '%src13%' AS refused
              FROM (SELECT doc_id, text, source, coalesce(NULLIF(source, ''), 'Concept') AS topic FROM documents))"""


def _derive(spark: SparkSession, folder: str, kind: str, column: str) -> DataFrame:
    docs = inputs.table(spark, folder, "documents")
    made = explain.derive_material(docs, kind, _stub_generator, topic="source", keep=("doc_id",))
    return made.select("doc_id", "topic", column, "metadata.temperature", "metadata.max_tokens", "error")


@query("derive_analogies", _derived("analogy", "analogies", 256), workers=True)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _derive(spark, folder, "analogy", "analogies")


@query("derive_examples", _derived("example", "examples", 384), workers=True)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _derive(spark, folder, "example", "examples")


def _quiz_generator():
    """A quiz of one question whose number of options depends on the prompt's length."""

    def run(requests):
        out = []
        for r in requests:
            n = len(r["prompt"]) % 4
            options = ", ".join(f'"{c}"' for c in "ABCD"[: n + 1])
            item = f'{{"question": "q", "options": [{options}], "correct_index": {n}, "rationale": "r"}}'
            out.append(item if n == 0 else f"Quiz:\n```json\n[{item}]\n```")
        return out

    return run


@query(
    "make_quizzes",
    f"""SELECT doc_id, CASE WHEN n % 4 > 0 THEN CAST(1 AS BIGINT) END AS questions, CASE WHEN n % 4 > 0 THEN n % 4 + 1 END AS options,
               (['A', 'B', 'C', 'D'])[CASE WHEN n % 4 > 0 THEN n % 4 + 1 END] AS answer, CASE WHEN n % 4 > 0 THEN true END AS count_differs,
               CASE WHEN n % 4 = 0 THEN coalesce(given, '') ELSE topic END AS topic,
               CASE WHEN n % 4 > 0 THEN CAST(3 AS BIGINT) END AS num_questions,
               CASE WHEN n % 4 > 0 THEN CAST(0.4 AS DOUBLE) END AS temperature,
               CASE WHEN n % 4 = 0 THEN 'Failed to parse questions JSON' END AS error
        FROM (SELECT doc_id, given, topic, {_request_length(_prompt('quiz'))} AS n
              FROM (SELECT doc_id, text, given, coalesce(NULLIF(given, ''), {FIRST_SENTENCE}) AS topic
                    FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN source END AS given FROM documents)))""",
    workers=True,
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    """Every other document comes without a topic of the caller's."""
    docs = inputs.table(spark, folder, "documents")
    given = docs.withColumn("given", F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    made = explain.make_quizzes(given, _quiz_generator, topic="given", keep=("doc_id",))
    item = F.get("items", F.lit(0))
    return made.select(
        "doc_id",
        F.when(F.col("items").isNotNull(), F.size("items")).alias("questions"),
        F.when(item.isNotNull(), F.size(item["options"])).alias("options"),
        quiz.answer_of(item).alias("answer"),
        "count_differs",
        "topic",
        "metadata.num_questions",
        "metadata.temperature",
        "error",
    )


# --- quizzes -------------------------------------------------------------------------


@query(
    "parse_quiz",
    with_inputs("quiz_list", "SELECT doc_id, parsed IS NOT NULL AS found, CAST(len(parsed) AS BIGINT) AS items FROM quiz_list"),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    parsed = quiz.parse_quiz(inputs.quiz_raw(spark, folder))
    found = F.col("parsed").isNotNull()
    return parsed.select("doc_id", found.alias("found"), F.when(found, F.size("parsed")).alias("items"))


@query(
    "check_quiz",
    with_inputs("quiz", "SELECT doc_id, error, CASE WHEN error IS NULL THEN len(parsed) <> 2 END AS count_differs FROM quiz"),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    checked = quiz.check_quiz(inputs.quiz_raw(spark, folder), num_questions=2)
    return checked.select("doc_id", "error", "count_differs")


@query(
    "quiz_rows",
    with_inputs(
        "questions",
        """SELECT doc_id, number, question, array_to_string(options, '|') AS options,
                  options[correct_index + 1] AS answer, rationale FROM questions""",
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = quiz.quiz_rows(quiz.check_quiz(inputs.quiz_raw(spark, folder)), "doc_id")
    return rows.withColumn("options", F.array_join("options", "|"))


@query(
    "quiz_markdown",
    with_inputs(
        "questions",
        f"""SELECT q.doc_id, CASE WHEN error IS NOT NULL THEN 'Received unexpected format for questions: ' || error || ': ' || raw
                                  ELSE coalesce(markdown, '') END AS markdown
            FROM quiz q LEFT JOIN (
                SELECT doc_id, string_agg('**Q' || number || ': ' || question || '**' || {NL}
                       || array_to_string(list_transform(options, lambda o: '- ' || o), {NL})
                       || {NL} || '**Answer:** ' || coalesce(options[correct_index + 1], '')
                       || {NL} || '**Rationale:** ' || coalesce(rationale, '') || {NL}, {NL} || {NL} ORDER BY number) AS markdown
                FROM questions GROUP BY doc_id) m ON m.doc_id = q.doc_id""",
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    checked = quiz.check_quiz(inputs.quiz_raw(spark, folder))
    return quiz.quiz_markdown(checked).select("doc_id", "markdown")


@query("quiz_rejects", with_inputs("quiz", "SELECT doc_id, error, raw FROM quiz WHERE error IS NOT NULL"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return quiz.quiz_rejects(quiz.check_quiz(inputs.quiz_raw(spark, folder)), "doc_id")
