"""Named queries over the tables of a data directory. The SQL they are compared with is in ``catalog_sql`` and ``catalog_sql_forms``."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import chat, paths, text, urls
from quillmesh.functions.markdown import markdown_components, markdown_page
from quillmesh.functions.speech import speakable
from quillmesh.functions.vectors import l2_normalize, norm
from quillmesh.operators import batching, chunking, citations, layout, reading, relational, retrieval, web
from quillmesh.plans import catalog_sql_forms
from quillmesh.plans.catalog_sql import PAGES, SQL, THOUGHTS
from quillmesh.plans.config import QueryConfig
from quillmesh.sources import files, store
from quillmesh.streaming import metrics, thinking
from quillmesh.streaming.ingest import file_stream, ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """An input that comes in fewer partitions than there are cores (one small file), dealt out evenly for costly work.

    Tables of many files, as on a cluster, pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a local session without one gets a temporary folder, a cluster without one is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named is None and not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="quillmesh-")


def checkpointed(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


# ---------------------------------------------------------------- chunks


@query
def chunk_fixed(spark, d):
    return chunking.fixed(spread(table(spark, d, "documents").select("doc_id", "text")))


@query
def chunk_overlap_variants(spark, d):
    return chunking.fixed(spread(table(spark, d, "documents").select("doc_id", "text")), size=1200, overlap=600)


@query
def chunk_paged(spark, d):
    pdf = spread(table(spark, d, "document_metadata").select("id", "file_name", "page_content")).where(paths.extension(text.strip(F.col("file_name"))) == ".pdf")
    return chunking.paged(pdf.select("id", "page_content"), "page_content")


@query
def chunk_documents(spark, d):
    return chunking.split_documents(spread(table(spark, d, "document_records").select("file_path", "file_type", "page_content"))).drop("file_type")


@query
def split_counts(spark, d):
    """What splitting makes of the documents of each type; captions of nothing but invisible characters are added."""
    rows = table(spark, d, "document_records").select(F.lower("file_type").alias("file_type"), "page_content")
    return chunking.split_counts(spread(rows.unionAll(spark.range(3).select(F.lit(".png"), F.lit("\u200b\u00ad \ufeff")))))


@query
def chunk_heading(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "(?m)^#+ ", "### ").alias("text")))
    return chunking.headings(docs)


@query
def chunk_stats(spark, d):
    stats = chunking.length_stats(chunk_fixed(spark, d))
    return stats.withColumn("mean_length", F.round("mean_length", 6))


@query
def oversize_chunks(spark, d):
    return chunking.oversize(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", F.length("text").alias("chars"))


@query
def assembled_pages(spark, d):
    pages = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 4).alias("doc_id"), (F.col("doc_id") % 4 + 1).alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return chunking.assemble_pages(pages)


@query
def chunks_per_database(spark, d):
    """Chunks each registered database would get with its own sizes."""
    docs = table(spark, d, "documents").select("source", F.length(text.strip(F.col("text"))).alias("n")).where(F.col("n") > 0)
    registry = table(spark, d, "created_databases")
    step = F.greatest(F.col("chunk_size") - F.col("chunk_overlap"), F.lit(1))
    sizes = docs.join(registry, F.col("source") == F.col("db_name"))
    return sizes.groupBy("db_name").agg(F.sum(F.ceil(F.col("n") / step)).cast("long").alias("chunks"), F.count(F.lit(1)).alias("documents"))


# ---------------------------------------------------------------- text


@query
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", paths.content_hash(F.col("text")).alias("hash"))


@query
def stale_hashes(spark, d):
    """Stored rows by what their hash is worth."""
    own = paths.content_hash(F.col("page_content"))
    state = F.when(F.coalesce("hash", F.lit("")) == "", "missing").when(F.col("page_content").isNull(), "no text").when(F.lower("hash") == own, "valid").otherwise("stale")
    return table(spark, d, "document_metadata").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query
def duplicate_docs(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.groupBy(paths.content_hash(F.col("text")).alias("hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query
def first_of_content(spark, d):
    return relational.first_of_content(table(spark, d, "document_metadata").select("id", "hash", "file_name"))


@query
def normalize_text(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.normalize(F.col("text")).alias("normalized"))


@query
def normalize_single_line(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", text.normalize(F.col("text"), False).alias("normalized"), text.normalize_query(F.col("text")).alias("query_form"))


@query
def clean_context(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_context(F.col("text")).alias("cleaned"))


@query
def corrupt_fraction(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", F.repeat(F.lit("(cid:12)"), (F.col("doc_id") % 3).cast("int"))).alias("text"))
    return docs.select("doc_id", F.round(text.corrupt_fraction(F.col("text")), 6).alias("fraction"))


@query
def think_strip(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", f"{THOUGHTS} AS answer").select("doc_id", text.strip_thinking(F.col("answer")).alias("answer"))


@query
def think_pieces(spark, d):
    """The same answers, arriving in pieces of seven characters."""
    whole = table(spark, d, "documents").selectExpr("doc_id AS conv_id", f"{THOUGHTS} AS answer")
    cuts = F.transform(F.sequence(F.lit(0), F.length("answer"), F.lit(7)), lambda p: F.substring(F.col("answer"), p + 1, F.lit(7)))
    pieces = whole.where("answer IS NOT NULL").select("conv_id", F.posexplode(cuts).alias("seq", "piece")).withColumn("seq", F.col("seq").cast("long"))
    return thinking.filter_pieces(pieces).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x.piece), "").alias("answer"))


@query
def stream_answers(spark, d):
    """The same answers as a stream of pieces, each ended by a null piece."""
    base = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    whole = table(spark, d, "documents").selectExpr("doc_id AS conv_id", f"{THOUGHTS} AS answer").where("answer IS NOT NULL")
    cuts = F.transform(F.sequence(F.lit(0), F.length("answer"), F.lit(7)), lambda p: F.substring(F.col("answer"), p + 1, F.lit(7)))
    pieces = whole.select("conv_id", F.posexplode(F.concat(cuts, F.array(F.lit(None).cast("string")))).alias("seq", "piece")).withColumn("seq", F.col("seq").cast("long"))
    pieces.write.parquet(f"{base}/in")
    out = thinking.filter_stream(spark.readStream.schema(pieces.schema).parquet(f"{base}/in"))
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    shown = spark.read.schema(out.schema).parquet(f"{base}/out")
    return shown.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x.piece), "").alias("answer"))


@query
def answers_gathered(spark, d):
    """Answers that arrive in pieces of seven characters, gathered for display."""
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(7)), lambda p: F.substring(F.col("text"), p + 1, F.lit(7)))
    pieces = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("conv_id"), F.posexplode(cuts).alias("seq", "piece"))
    return thinking.gathered(pieces)


@query
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query
def rendered_response(spark, d):
    return table(spark, d, "documents").select("doc_id", text.render_response(F.col("text")).alias("html"))


@query
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("n", "sentence"))


@query
def sentence_packs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.pack_sentences(F.col("text"))).alias("n", "piece"))


@query
def sentences_kept(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.sentences_kept(F.col("text"))).alias("n", "sentence"))


@query
def flattened_texts(spark, d):
    """Texts of every five documents as one, nulls and empty ones left out."""
    groups = table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 5).alias("n")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("e"))
    return groups.select("n", text.flatten_texts(F.transform("e", lambda x: x.text)).alias("text"))


@query
def joined_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", text.join_lines(F.col("text")).alias("line"))


@query
def speakable_text(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", speakable(F.col("text")).alias("spoken"))


@query
def chat_prompts(spark, d):
    """Every document as a question, in the form of each model family."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    forms = F.array(*(F.struct(F.lit(f).alias("family"), chat.chat_prompt(f, F.lit("Be brief."), F.col("text")).alias("prompt")) for f in chat.TEMPLATES))
    return docs.select("doc_id", F.explode(forms).alias("f")).select("doc_id", "f.family", "f.prompt")


@query
def assistant_prompts(spark, d):
    """A prompt for every five documents, their texts as excerpts."""
    docs = table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 5).alias("n")).agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("doc_id", "text")))).alias("e"))
    return docs.select("n", chat.assistant_prompt("Answer from the excerpts.", F.transform("e", lambda x: x.text), F.lit("What now?")).alias("prompt"))


@query
def realigned_chunks(spark, d):
    """Chunks of the documents whose vectors came through."""
    return retrieval.realigned(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id").select("doc_id")


@query
def prefixed_queries(spark, d):
    """What each registered model is given for a query; models of the known families are added."""
    named = table(spark, d, "created_databases").select("db_name", F.coalesce("model", F.concat(F.lit("vendor/BGE-base-"), F.col("db_name"))).alias("model"))
    return named.select("db_name", text.model_family(F.col("model")).alias("family"), text.max_sequence(F.col("model")).alias("max_sequence"), text.prefixed_query(F.lit("  what is\ta quorum? "), F.col("model")).alias("query"))


# ---------------------------------------------------------------- metadata


@query
def document_paths(spark, d):
    p = F.col("file_path")
    return table(spark, d, "document_metadata").select("id", paths.base_name(p).alias("name"), paths.extension(p).alias("extension"), paths.stem(p).alias("stem"), paths.document_type(p).alias("kind"))


@query
def doctype_distribution(spark, d):
    kind = F.coalesce("document_type", paths.document_type(F.col("file_path")))
    return table(spark, d, "document_records").groupBy(kind.alias("document_type"), F.lower("file_type").alias("file_type")).agg(F.count(F.lit(1)).alias("n"))


@query
def metadata_roundtrip(spark, d):
    fields = ["file_path", "file_type", "file_name", "hash"]
    rows = table(spark, d, "document_records").select("file_path", store.metadata_json(*fields).alias("metadata"))
    parsed = rows.select("file_path", store.parsed_metadata(F.col("metadata"), ", ".join(f"{f} string" for f in fields)).alias("m"))
    return parsed.where("m IS NOT NULL").groupBy("m.file_type").agg(F.count(F.lit(1)).alias("n"), F.count("m.hash").alias("with_hash"))


@query
def chunk_metadata(spark, d):
    """Metadata that goes with a chunk: scalars, nulls left out, times and lists as text."""
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", "ingested_at", F.array("source", "lang").alias("both"))
    return rows.select("doc_id", store.chunk_metadata(rows, "source", "lang", "ingested_at", "both").alias("metadata"))


@query
def latest_versions(spark, d):
    """The latest text of every path: greatest modification date, then hash and text hash, nulls least; combined before the shuffle, which carries no text."""
    dated = table(spark, d, "document_records").select("file_path", "modification_date", "hash", F.sha2("page_content", 256).alias("text_hash"))
    latest = dated.groupBy("file_path").agg(F.max(F.struct("modification_date", "hash", "text_hash")).alias("r"), F.count_distinct("text_hash").cast("int").alias("versions"))
    return latest.select("file_path", "r.modification_date", "r.text_hash", "versions")


@query
def impossible_dates(spark, d):
    t = lambda c: F.try_to_timestamp(F.col(c))
    return table(spark, d, "document_records").where(t("modification_date") < t("creation_date")).groupBy("document_type").agg(F.count(F.lit(1)).alias("n"))


@query
def staged_names(spark, d):
    return files.staging(table(spark, d, "document_metadata").select(F.col("file_path").alias("path"))).withColumnRenamed("path", "file_path")


@query
def file_listing(spark, d):
    return table(spark, d, "document_metadata").select("file_name", "file_path").orderBy("file_name", "file_path")


@query
def kept_downloads(spark, d):
    keep = relational.kept_by_globs(F.col("file_name"), ["*.pdf", "*.txt", "*.md"], ["*copy*", "index.*"])
    files = table(spark, d, "document_metadata").where(F.col("file_name").isNotNull())
    return files.agg(F.count_if(keep).alias("files"), F.sum(F.when(keep, F.octet_length("page_content"))).alias("bytes"))


# ---------------------------------------------------------------- files and stores


def _files(spark, d):
    """The corpus as files: texts, records, pages and mails by turns; every eleventh of a type that has no loader."""
    docs = spread(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    quoted = F.concat(F.lit('"'), F.replace(F.col("text"), F.lit('"'), F.lit('""')), F.lit('"'))
    by_type = {
        ".txt": F.col("text"),
        ".CSV": F.concat(F.col("doc_id"), F.lit(","), quoted),
        ".html": F.concat(F.lit("<html><head><title>"), F.col("doc_id"), F.lit("</title><style>p {}</style></head><body><nav>menu</nav><p>x"), text.escape_html(F.col("text")), F.lit("</p><script>var a;</script><footer>foot</footer></body></html>")),
        ".eml": F.concat(F.lit("Subject: Note "), F.col("doc_id"), F.lit("\nMIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), F.col("text")),
    }
    kind = F.when(F.col("doc_id") % 11 == 10, ".odt")
    content = F.lit(None)
    for k, (extension, body) in enumerate(by_type.items()):
        kind = kind.when(F.col("doc_id") % 4 == k, extension)
        content = body if k == 0 else F.when(F.col("doc_id") % 4 == k, body).otherwise(content)
    return docs.select(F.concat(F.lit("/in/f"), F.col("doc_id"), kind).alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modificationTime"), F.encode(content, "UTF-8").alias("content"))


@query
def file_compatibility(spark, d):
    """Stored files by whether a type of theirs is known."""
    named = table(spark, d, "document_metadata").where("file_path IS NOT NULL").select(F.concat("file_path", F.when(F.col("id") % 5 == 0, ".bak").otherwise("")).alias("path"))
    return files.incompatible(named).select("path", F.lit(False).alias("known")).unionAll(files.compatible(named).select("path", F.lit(True)))


@query
def file_times(spark, d):
    return table(spark, d, "documents").select("doc_id", files.iso_time(F.col("ingested_at")).alias("ingested"))


@query
def own_databases(spark, d):
    """The registry without the built-in manual, which is added here."""
    rows = table(spark, d, "created_databases").select("db_name", "chunk_size")
    return store.user_databases(rows.unionAll(spark.range(1).selectExpr("'user_manual'", "CAST(1 AS INT)")))


@query
def loaded_files(spark, d):
    """Files through the loaders of their types, with the reason where one gave nothing."""
    return files.extract(_files(spark, d)).select("file_path", "file_type", "page_content", "hash", "error")


@query
def loaded_pdfs(spark, d):
    """The words of every text on a page of its own, and a page without any, through the loader."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "), " +", " "))
    one = "%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Type/Pages/Kids[3 0 R 5 0 R]>>endobj 3 0 obj<</Type/Page>>endobj 5 0 obj<</Type/Page/Contents 4 0 R>>endobj 4 0 obj<<>>stream\nBT 9 9 Td ("
    content = F.encode(F.concat(F.lit(one), words, F.lit(") Tj ET\nendstream endobj trailer<</Root 1 0 R>>")), "UTF-8")
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select(F.concat(F.lit("/in/f"), "doc_id", F.lit(".PDF")).alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modificationTime"), content.alias("content"))
    return files.extract(docs).select("file_path", "file_type", "page_content", "error")


@query
def ingest_counts(spark, d):
    return files.ingest_counts(files.extract(_files(spark, d)))


@query
def transcripts_again(spark, d):
    """Documents written as transcripts and read back."""
    folder = f"{shared_folder(spark)}/transcripts-{uuid.uuid4().hex}"
    files.write_transcripts(table(spark, d, "document_records"), folder)
    return files.transcripts(spark, folder).select("file_path", "file_name", F.sha2("page_content", 256).alias("text_hash"), "document_type", "creation_date", F.col("error").isNotNull().alias("broken"))


@query
def store_points(spark, d):
    """A vector store built, copied and restored; rows by id with the norms it keeps."""
    root, name = shared_folder(spark), f"db{uuid.uuid4().hex}"
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.lit("t").alias("text"), F.to_json(F.struct("label")).alias("metadata"))
    first = store.VectorStore(spark, root, name)
    first.build(vectors, table(spark, d, "document_metadata"), table(spark, d, "hash_chunk_ids"), 64)
    first.backup(f"{root}/backup")
    first.delete()
    first.restore(f"{root}/backup")
    wanted = table(spark, d, "document_metadata").select(F.col("id").cast("string").alias("id"))
    return first.point_read(wanted, ["metadata", "norm"]).select("id", "metadata", F.round("norm", 4).alias("norm"))


@query
def store_without(spark, d):
    """What is left of a store without the documents of the most frequent hash."""
    root, name = shared_folder(spark), f"db{uuid.uuid4().hex}"
    ids = table(spark, d, "hash_chunk_ids").where("hash <> ''")
    vectors = ids.select(F.col("tiledb_id").alias("id"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("vector"), F.lit("").alias("text"), F.lit("{}").alias("metadata"))
    first = store.VectorStore(spark, root, name)
    first.build(vectors, table(spark, d, "document_metadata"), ids, 2)
    most = ids.groupBy("hash").count().orderBy(F.desc("count"), "hash").limit(1)
    less = first.delete_documents(most)
    counts = [less.table(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("part"), "n") for t in store.TABLES]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


@query
def ingested_once(spark, d):
    """Chunks of documents that arrive as a stream, which runs twice and takes each file once."""
    base = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    docs = table(spark, d, "document_records").select("file_path", "file_type", "page_content")
    stream = file_stream(spark, f"{d}/document_records.parquet", docs.schema)
    for _ in range(2):
        ingest(stream, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("file_path").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk")).alias("characters"))


# ---------------------------------------------------------------- joins and sets


@query
def chunks_per_document(spark, d):
    owned = relational.children_by_hash(table(spark, d, "hash_chunk_ids"), table(spark, d, "document_metadata"))
    return owned.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("copies").alias("copies"))


@query
def orphan_chunks(spark, d):
    known = table(spark, d, "document_metadata").where("hash <> ''").select(F.lower("hash").alias("h")).distinct()
    return table(spark, d, "hash_chunk_ids").withColumn("h", F.lower("hash")).join(known, "h", "left_anti").select("tiledb_id", "hash")


@query
def registry_models(spark, d):
    """Precision of each database's model: exact name, else contained name, else the default."""
    registry = spark.createDataFrame([("Ostrea-large", "Ostrea", "float16"), ("Quill-small", "Quill", "bfloat16"), ("vendor/bge", "bge", "float32")], "repo string, family string, precision string")
    rows = table(spark, d, "created_databases").select("db_name", F.coalesce("model", F.lit("none")).alias("model"))
    return relational.lookup(rows, "model", registry, "repo", "family", "precision", "float32").select("db_name", "model", "precision")


@query
def source_union(spark, d):
    stored = table(spark, d, "document_metadata").select("file_path", "hash")
    extracted = table(spark, d, "document_records").select("file_path", "hash", "document_type")
    return relational.union_sources(extracted, stored).groupBy("source_no", "document_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hash").alias("hashes"))


@query
def set_diff(spark, d):
    return relational.set_difference(table(spark, d, "document_metadata").select("file_path"), table(spark, d, "document_records").select("file_path"), "file_path")


@query
def gpu_rank(spark, d):
    """A ranking by one measure within a range of another, in percent of the greatest."""
    ranked = relational.percent_of_max(relational.ranked_between(table(spark, d, "part"), "p_size", 10, 20, "p_retailprice", "p_partkey"), "p_retailprice", "percent")
    return ranked.select("p_partkey", "p_size", "p_retailprice", F.round("percent", 6).alias("percent"))


@query
def repeated_metadata(spark, d):
    """Rows whose metadata is that of the row before, within write batches of 1,000 ids."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.floor(F.col("doc_id") / 1000).alias("batch"))
    runs = relational.consecutive_runs(docs, "batch", "doc_id", F.struct("lang", "source"))
    return runs.groupBy("batch").agg(F.count_if("repeats").alias("repeats"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- search


@query
def knn_topk(spark, d):
    hits = retrieval.topk_of(table(spark, d, "embeddings"), 0, 5)
    return hits.select("vec_id", F.round("similarity_score", 6).alias("similarity_score"), "rank")


@query
def knn_multi(spark, d):
    vectors = table(spark, d, "embeddings")
    hits = retrieval.topk_many(vectors, vectors.where("vec_id % 20 = 0"), 5)
    return hits.select("query_id", "id", F.round("similarity_score", 5).alias("similarity_score"), "rank")


@query
def vector_norms(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(norm(v), 5).alias("norm"), F.round(norm(l2_normalize(v)), 5).alias("unit"))


def _hits(spark, d, **settings):
    config = QueryConfig(**{"contexts": 20, "similarity": 0.2, **settings})
    docs = table(spark, d, "documents").select("doc_id", "text", "document_type", "source")
    return retrieval.search(table(spark, d, "embeddings"), docs, 0, config)


def _scored(hits):
    return hits.select("doc_id", F.round("similarity_score", 6).alias("similarity_score"), "rank")


@query
def search_threshold(spark, d):
    return _scored(_hits(spark, d))


@query
def search_term(spark, d):
    return _scored(_hits(spark, d, search_term="THE"))


@query
def search_type(spark, d):
    return _scored(_hits(spark, d, document_types="document"))


@query
def search_nothing(spark, d):
    """No chunk passes: the advice."""
    return retrieval.chunks_only(_hits(spark, d, search_term="no text has these words, says the search"), "source")


@query
def search_chunks_only(spark, d):
    return retrieval.chunks_only(_hits(spark, d), "source")


@query
def rag_prompt(spark, d):
    return retrieval.prompt(_hits(spark, d).where(F.col("text").isNotNull()), "What was decided?")


@query
def token_budget(spark, d):
    return retrieval.token_budget(_hits(spark, d).where(F.col("text").isNotNull()), "What was decided?", 4096)


@query
def distance_stats(spark, d):
    stats = retrieval.distance_stats(retrieval.topk_of(table(spark, d, "embeddings"), 0, 20))
    return stats.select(*(F.round(c, 6).alias(c) for c in stats.columns))


@query
def cited_sources(spark, d):
    hits = retrieval.topk_of(table(spark, d, "embeddings"), 0, 40)
    meta = table(spark, d, "document_metadata").select(F.col("id").alias("vec_id"), "file_path", "file_name", paths.extension(F.col("file_path")).alias("file_type"))
    paged = hits.join(meta, "vec_id").withColumn("page_number", (F.col("vec_id") % 7 + 1).cast("int"))
    grouped = paged.withColumn("file_path", F.regexp_extract("file_path", r"^(.*?[/\\].*?[/\\].*?)[/\\]", 1)).withColumn("file_type", F.lit(".pdf"))
    cited = citations.citations(grouped)
    return cited.select("file_path", "scores", "pages", F.round("min_score", 6).alias("min_score"))


@query
def citation_html(spark, d):
    hits = retrieval.topk_of(table(spark, d, "embeddings"), 0, 10)
    meta = table(spark, d, "document_metadata").select(F.col("id").alias("vec_id"), "file_path", "file_name", paths.extension(F.col("file_path")).alias("file_type"))
    return citations.citation_list(citations.citations(hits.join(meta, "vec_id").withColumn("page_number", F.lit(1))))


@query
def page_ranges(spark, d):
    pages = table(spark, d, "document_metadata").select("id", F.explode(F.regexp_extract_all("page_content", F.lit(chunking.MARKER), 1)).alias("p")).select("id", F.col("p").cast("int").alias("page_number"))
    return citations.page_ranges(pages, ["id"])


@query
def page_ranges_array(spark, d):
    pages = F.regexp_extract_all("page_content", F.lit(chunking.MARKER), 1).cast("array<int>")
    return table(spark, d, "document_metadata").select("id", citations.page_ranges_of(pages).alias("pages")).where("pages <> ''")


# ---------------------------------------------------------------- web


def pages_of(spark, d):
    """Pages made of the corpus: chrome around the text, links to other pages."""
    return table(spark, d, "documents").selectExpr(*PAGES)


@query
def link_extract(spark, d):
    return web.links(pages_of(spark, d))


@query
def url_valid(spark, d):
    p = pages_of(spark, d)
    candidate = F.concat(F.lit("https://www.docs.example/guide-v1."), F.col("doc_id") % 5, F.when(F.col("doc_id") % 3 == 0, "-old").otherwise(""), F.lit("/page"), F.col("doc_id"))
    return p.select("doc_id", urls.is_valid(candidate, F.lit("docs.example"), F.lit("/guide-v1.2/page")).alias("deep"), urls.is_valid(candidate, F.lit("docs.example"), F.lit("/guide-v1.2")).alias("valid"), urls.is_valid(candidate, F.lit("other.example"), F.lit("")).alias("elsewhere"))


@query
def html_filename(spark, d):
    return pages_of(spark, d).select("doc_id", urls.file_name(F.concat("url", F.when(F.col("doc_id") % 4 == 0, "?a=1").otherwise(""))).alias("file_name"))


@query
def html_strip_cruft(spark, d):
    return pages_of(spark, d).select("doc_id", web.strip_tag_blocks(F.col("html")).alias("html"))


@query
def html_plain(spark, d):
    return pages_of(spark, d).select("doc_id", web.tags_to_text(F.col("html")).alias("text"))


@query
def html_main_content(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", text.escape_html(F.col("text")).alias("text"), "source"))
    return docs.selectExpr(*PAGES).select("doc_id", web.content_and_text(F.col("html"), "pydata").alias("r")).select("doc_id", "r.content", "r.text")


@query
def html_by_site(spark, d):
    """Main content by the selector registered for each page's site."""
    docs = spread(table(spark, d, "documents").select("doc_id", text.escape_html(F.col("text")).alias("text"), "source"))
    sites = web.SiteRegistry()
    sites.register("https://docs.example/docs", "pydata")
    sites.register("https://docs.example/docs/7", "readthedocs")
    pages = docs.selectExpr(*PAGES).withColumn("url", F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("https://elsewhere.example/"), "doc_id")).otherwise(F.col("url")))
    return web.content_by_site(pages, sites).select("doc_id", "content")


@query
def markdown_pages(spark, d):
    """Each text as a note within extended markdown, and as HTML."""
    words = text.strip(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9 ]+", " "))
    note = F.concat(F.lit('# Title\n<Note>\n  '), F.regexp_replace(words, " +", " "), F.lit('\n</Note>\n<Card title="More">see `<b>`</Card>'))
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", note.alias("note"))
    return docs.select("doc_id", markdown_components(F.col("note")).alias("plain"), markdown_page(F.col("note")).alias("page"))


@query
def index_seeds(spark, d):
    """Pages that an index file made of the corpus names below a prefix of one host."""
    line = F.concat(F.lit("- [page]("), F.when(F.col("doc_id") % 3 == 0, "https://docs.example/guide/").when(F.col("doc_id") % 3 == 1, "https://docs.example/other/").otherwise("https://elsewhere.example/guide/"), F.col("doc_id"), F.when(F.col("doc_id") % 4 == 0, ".html").otherwise(".md"), F.lit("): text"))
    indexes = table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 50).alias("n")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t"))
    return indexes.select("n", F.explode(web.seeds_of_index(F.col("t"), "docs.example", "/guide")).alias("url"))


@query
def html_saved(spark, d):
    return web.saved_pages(pages_of(spark, d))


@query
def link_frontier(spark, d):
    return web.frontier(web.links(pages_of(spark, d)), pages_of(spark, d).where("doc_id % 2 = 0"))


@query
def crawl(spark, d):
    """All pages that links lead to from one, with their distance."""
    links = checkpointed(web.links(pages_of(spark, d)))
    return web.crawl(links, pages_of(spark, d).where("doc_id = 1").select("url"), checkpointed)


@query
def crawl_tries(spark, d):
    """Requests made of the event log: an event is an answer, numbered per page; pages without a 200 in three tries are failed."""
    status = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "purchase", 200).otherwise(404)
    answers = table(spark, d, "events").select(F.concat(F.lit("https://docs.example/"), F.col("event_id") % 97, F.lit("/"), F.col("user_id")).alias("url"), "event_id", status.alias("status"))
    numbered = relational.running_total(answers, ["url"], ["event_id"], F.floor(F.col("event_id") / 10_000), F.lit(1), "attempt")
    return web.after_tries(numbered)


@query
def seeds_merged(spark, d):
    """Pages in the order of their texts' sizes after every other page in its own order, each once."""
    pages = pages_of(spark, d).select("url", "doc_id")
    return web.merge_seeds(pages.where("doc_id % 2 = 0").select("url", F.col("doc_id").alias("position")), pages.select("url", (-F.col("doc_id")).alias("position")))


@query
def queue_unsaved(spark, d):
    """Pages whose file isn't saved yet."""
    pages = pages_of(spark, d)
    return web.unsaved(pages.select("url"), web.saved_pages(pages.where("doc_id % 3 = 0")))


@query
def page_sidecars(spark, d):
    """The links kept beside each saved page."""
    return web.links_beside(pages_of(spark, d))


@query
def resumed_queue(spark, d):
    pages = pages_of(spark, d)
    return web.resume_queue(web.links(pages.where("doc_id % 5 = 0")).select("link"), pages.where("doc_id % 7 = 0").select("url"), pages.where("doc_id < 3").select("url"))


@query
def rate_limits(spark, d):
    responses = table(spark, d, "events").select(F.col("user_id").alias("site"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "purchase", 200).otherwise(404).alias("status"))
    return web.rate_limited(responses)


# ---------------------------------------------------------------- encoder batches


@query
def length_sorted_batches(spark, d):
    sized = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.length("text").alias("n"))
    return batching.length_sorted(sized, F.col("n"), "doc_id", shard_size=5000, batch_size=64).select("doc_id", "shard", "position", "batch_id")


@query
def batch_padding(spark, d):
    sized = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.length("text").alias("n"))
    return batching.batch_stats(batching.length_sorted(sized, F.col("n"), "doc_id", shard_size=5000, batch_size=64))


@query
def padding_efficiency(spark, d):
    return batching.padding_efficiency(batch_padding(spark, d)).withColumn("efficiency", F.round("efficiency", 6))


@query
def restored_order(spark, d):
    """Sorted by length for encoding, then back in the order of the chunks."""
    sized = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.length("text").alias("n"))
    return batching.restore_order(batching.length_sorted(sized, F.col("n"), "doc_id", shard_size=5000, batch_size=64), "doc_id").select("doc_id", "n_tokens")


@query
def padded_tokens(spark, d):
    tokens = batching.tokenize(table(spark, d, "documents"), "doc_id", "text")
    padded = batching.padded_batches(tokens, "doc_id", shard_size=5000, batch_size=64)
    return padded.groupBy("shard", "batch_id").agg(F.min(F.size("input_ids")).alias("shortest"), F.max(F.size("input_ids")).alias("longest"), F.sum(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)).alias("real_tokens"))


def _letters(texts: list[str]) -> list[list[int]]:
    """A tokenizer that takes no tabs: code points."""
    if any("\t" in t for t in texts):
        raise ValueError("tab")
    return [list(map(ord, t)) for t in texts]


@query
def tokenized(spark, d):
    """Texts through a tokenizer that fails for some, one at a time; what came through and what didn't."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    rows = batching.tokenize_with(docs, "doc_id", "text", _letters, batch_size=1)
    return rows.select("doc_id", F.size("input_ids").alias("tokens"), F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), "error")


@query
def tokens_to_resume(spark, d):
    """What is left for a run that stopped after every third document."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return batching.still_to_do(docs, docs.where("doc_id % 3 = 0"), "doc_id")


@query
def hashed_embeddings(spark, d):
    vectors = batching.hashed_embedding(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", 16)
    return vectors.select("doc_id", F.posexplode("embedding").alias("place", "x")).select("doc_id", "place", F.round(F.col("x").cast("double"), 4).alias("x"))


QUESTION = "Which committee checks the harbour records?"


@query
def search_words(spark, d):
    """The chunks nearest to a question in words, encoded as the chunks are."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "document_type", "source"))
    vectors = batching.hashed_embedding(docs, "doc_id", "text", 32).withColumnRenamed("doc_id", "vec_id")
    hits = retrieval.search_text(vectors, docs, QUESTION, QueryConfig(contexts=20, similarity=0.0), batching.WordEncoder(32))
    return hits.select("doc_id", F.round("similarity_score", 4).alias("similarity_score"))


@query
def search_prefiltered(spark, d):
    """The nearest of the chunks that pass a term and a type, chosen before the limit."""
    docs = table(spark, d, "documents").select("doc_id", "text", "document_type", "source")
    config = QueryConfig(contexts=20, similarity=0.0, search_term="the", document_types="document")
    return _scored(retrieval.search(table(spark, d, "embeddings"), docs, 0, config, prefilter=True))


# ---------------------------------------------------------------- recognised pages


@query
def ocr_gate(spark, d):
    """Pages of the corpus with made-up features: which need recognition."""
    i = F.col("doc_id")
    pages = table(spark, d, "documents").select((i / 5).cast("long").alias("doc_id"), "text", (i % 7).cast("int").alias("interior_words"), ((i % 10) / 10.0).alias("image_cover"), (i % 23).cast("int").alias("drawings"))
    return layout.documents_need_ocr(pages)


@query
def ocr_events(spark, d):
    events = table(spark, d, "events").select(F.when(F.col("event_type") == "view", "notext").otherwise(F.col("event_type")).alias("kind"), (F.col("user_id") % 40).alias("page"), (F.col("value") / 5000).alias("ink_frac"))
    return layout.event_summary(events)


@query
def ocr_zoom(spark, d):
    w, h = F.col("p_size").cast("double") * 300, F.col("p_retailprice").cast("double") * 5
    return table(spark, d, "part").select("p_partkey", F.round(layout.safe_zoom(F.lit(4.0), w, h), 6).alias("zoom"))


PAGE_LINES = 40  # lines of a page that a text is laid out on


def _pages_of_words(spark, d):
    """All words of each document set in lines of two columns, on as many pages as they fill: one row per page."""
    words = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.split(F.trim("text"), " +").alias("_w"))
    starts = F.sequence(F.lit(0), F.floor((F.size("_w") - 1) / PAGE_LINES).cast("int"))
    pages = spread(words).select("doc_id", F.posexplode(F.transform(starts, lambda p: F.slice("_w", p * PAGE_LINES + 1, PAGE_LINES))).alias("page", "texts"))
    boxes = [(520.0 * (n % 2), n // 2 * 30.0) for n in range(PAGE_LINES)]
    places = F.array(*(F.array(*(F.array(F.lit(x + dx), F.lit(y + dy)) for dx, dy in ((0.0, 0.0), (400.0, 0.0), (400.0, 20.0), (0.0, 20.0)))) for x, y in boxes))
    return pages.withColumn("polygons", F.slice(places, F.lit(1), F.size("texts")))


@query
def reading_order(spark, d):
    pages = _pages_of_words(spark, d)
    return pages.select("doc_id", "page", F.posexplode(reading.line_positions(F.col("polygons"))).alias("line_no", "position")).withColumn("position", F.col("position").cast("long"))


@query
def hocr(spark, d):
    lines = _pages_of_words(spark, d).select("doc_id", "page", F.posexplode(F.arrays_zip("texts", "polygons")).alias("line_no", "_l"))
    score = (F.col("doc_id") + F.col("page") * PAGE_LINES + F.col("line_no")) % 11 / 10.0
    stats = layout.hocr_lines(lines.select("doc_id", "page", "line_no", F.col("_l.texts").alias("text"), F.col("_l.polygons").alias("polygon"), score.alias("score")), ["doc_id", "page"])
    return stats.select("doc_id", "page", "body", "emitted", "dropped", "flagged", F.round("mean_conf", 6).alias("mean_conf"))


@query
def line_scores(spark, d):
    """Text mass and mean confidence of every page's lines."""
    scored = _pages_of_words(spark, d).withColumn("scores", F.transform("texts", lambda t, k: (F.col("doc_id") + F.col("page") * PAGE_LINES + k) % 11 / 10.0))
    return scored.select("doc_id", "page", F.round(layout.text_mass(F.col("texts"), F.col("scores")), 4).alias("mass"), F.round(layout.mean_confidence(F.col("texts"), F.col("scores")), 6).alias("confidence"))


@query
def turned_boxes(spark, d):
    """Boxes of parts in pictures turned by quarter turns, in the pictures as they were."""
    w, h = F.col("p_size") + 10, F.col("p_partkey") % 50 + 10
    point = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    polygon = F.array(point(F.lit(1), F.lit(2)), point(w / 2, F.lit(3)), point(w / 2, h / 2), point(F.lit(0.5), h / 2))
    parts = table(spark, d, "part").select("p_partkey", w.cast("double").alias("w"), h.cast("double").alias("h"), polygon.alias("polygon"))
    turns = [parts.select("p_partkey", F.lit(k).alias("turns"), layout.bounding_box(layout.rotated_back(F.col("polygon"), k, F.col("w"), F.col("h"))).alias("b")) for k in range(4)]
    every = turns[0].unionAll(turns[1]).unionAll(turns[2]).unionAll(turns[3])
    return every.select("p_partkey", "turns", *(F.round(f"b.{c}", 4).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query
def outputs_verified(spark, d):
    """Orders as documents and their items as the pages that came out: which outputs are sound."""
    source = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(4).alias("pages"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(9).alias("chars"))
    items = table(spark, d, "lineitem").where("l_orderkey % 5 <> 0").groupBy(F.col("l_orderkey").alias("doc_id"))
    output = items.agg(F.count(F.lit(1)).cast("int").alias("pages"), F.sum(F.when(F.col("l_returnflag") == "R", 7).otherwise(0)).alias("chars"))
    return layout.verified_output(source, output)


@query
def page_metrics(spark, d):
    """Pages of the corpus with the counts of their layout markup; pages of blanks only have none."""
    pages = _pages_of_words(spark, d).select("doc_id", "page", F.size("texts").alias("words"))
    return layout.with_page_metrics(pages, hocr(spark, d).select("doc_id", "page", "emitted", "dropped"))


@query
def orientation(spark, d):
    trials = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.when(F.col("l_linenumber") == 1, "none").otherwise(F.concat(F.lit("rot"), F.col("l_linenumber"))).alias("orientation"), F.col("l_quantity").alias("mass"), (F.col("l_discount") * 10).alias("confidence")
    )
    return layout.best_orientation(trials)


# ---------------------------------------------------------------- measurements


def _samples(spark, d):
    return table(spark, d, "metrics_sample")


@query
def metrics_valid(spark, d):
    valid = metrics.valid_readings(_samples(spark, d))
    return valid.groupBy("session_id").agg(F.count(F.lit(1)).alias("samples"), *(F.count(c).alias(f"n_{c}") for c in metrics.PERCENTAGES), F.round(F.avg("cpu_usage"), 6).alias("avg_cpu"))


@query
def metrics_once(spark, d):
    return metrics.first_of_sample(_samples(spark, d)).groupBy("session_id").agg(F.count(F.lit(1)).alias("samples"), F.sum("sample_id").alias("id_sum"))


@query
def metrics_tumbling(spark, d):
    out = metrics.tumbling(metrics.first_of_sample(_samples(spark, d)))
    return out.select("session_id", "window_start", "samples", *(F.round(c, 6).alias(c) for c in ("avg_cpu", "max_cpu", "avg_ram", "avg_gpu")))


@query
def metrics_sliding(spark, d):
    return metrics.sliding(_samples(spark, d)).withColumn("avg_cpu", F.round("avg_cpu", 6))


@query
def metrics_bursts(spark, d):
    return metrics.bursts(_samples(spark, d))


@query
def metrics_history(spark, d):
    return metrics.history(_samples(spark, d)).select("sample_id", "in_history", F.round("mean_cpu", 6).alias("mean_cpu"))


@query
def metrics_latest(spark, d):
    return metrics.latest(_samples(spark, d), 100).select("session_id", "sample_id", "age")


@query
def metrics_lateness(spark, d):
    late = F.col("arrived_ts") - F.col("sample_ts") > F.expr("INTERVAL 1 HOUR")
    return _samples(spark, d).groupBy("session_id").agg(F.count_if(late).alias("late"), F.count(F.lit(1)).alias("samples"))


@query
def metrics_csv(spark, d):
    return metrics.as_csv_rows(_samples(spark, d))


@query
def stream_tumbling(spark, d):
    """The hourly windows as a stream: those that the watermark of three days has closed."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    samples = _samples(spark, d)
    stream = file_stream(spark, f"{d}/metrics_sample.parquet", samples.schema).withColumn("sample_ts", F.col("sample_ts").cast("timestamp"))
    out = metrics.tumbling(stream, late="3 days").select("session_id", "window_start", "samples", F.round("max_cpu", 6).alias("max_cpu"))
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


# ---------------------------------------------------------------- what Spark SQL brings along


def _relational(name: str, sql: str) -> None:
    """A query in SQL that runs alike on both sides; shows that the engine's own operators take part."""

    def run(spark, d):
        for t in ("customer", "orders", "lineitem", "nation", "region", "supplier", "part", "documents"):
            table(spark, d, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    run.__name__ = name
    query(run)


for _name, _sql in {k: v for k, v in SQL.items() if k.startswith("rel_")}.items():
    _relational(_name, _sql)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in (SQL | catalog_sql_forms.SQL).items() if k in _QUERIES}
