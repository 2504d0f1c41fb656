"""File sources: walks, recording archives, repositories, prompts, knowledge paths, graph JSON."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestrata.functions import text as T
from lodestrata.operators import graphstore as G
from lodestrata.sources import sessions

#: Endings of source files and of prompts, and folders that are passed over (fixed values).
SOURCE_ENDINGS = ".swift .ts .tsx .js .jsx .mjs .cjs .py .go .rs .java .kt .kts .c .h .cpp .hpp .md".split()
PROMPT_ENDINGS = ".md .txt .json .jsonl".split()
SKIPPED = ("node_modules", "dist", "build")
MEMORY_FILES = ("MEMORY.md", "USER.md")
#: Characters kept of a source file, a prompt, a document; terms tagged of each (fixed values).
REPOSITORY_CUT, PROMPT_CUT, DOCUMENT_CUT = 200_000, 100_000, 300_000
RECORDING_TERMS, PROMPT_TERMS, MEMORY_TERMS, FILE_TERMS = 12, 20, 24, 30
#: Types that a new reading of a path replaces.
REPLACED = ["document", "memory", "session", "turn"]
#: Subtrees a walk is cut into, at least, and files read by one task.
WALKS, PORTION = 64, 256
#: Files a portion may have at most.
PLACES = 1 << 20


class _Portion(InputPartition):
    """Files, or a folder that the task walks itself."""

    def __init__(self, no: int, files: list[str], folder: str | None = None) -> None:
        super().__init__((no, files, folder))
        self.no, self.files, self.folder = no, files, folder


class _WalkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.hidden = options["path"].removeprefix("file://"), options.get("hidden", "false").lower() == "true"

    def _passed(self, name: str) -> bool:
        return not self.hidden and (name.startswith(".") or name in SKIPPED)

    def _entries(self, folder: str) -> tuple[list[str], list[str]]:
        """Files and folders, in the order of their names; what can't be read is left out."""
        try:
            found = sorted((e for e in os.scandir(folder) if not self._passed(e.name)), key=lambda e: e.name)
        except OSError:
            return [], []
        return [e.path for e in found if e.is_file()], [e.path for e in found if e.is_dir(follow_symlinks=False)]

    def partitions(self) -> list[_Portion]:
        """The uppermost folders only are listed here; what lies below is walked by the tasks."""
        files: list[str] = []
        folders = [self.root]
        if os.path.isfile(self.root):
            files, folders = [self.root], []
        while folders and len(folders) < WALKS:
            level: list[str] = []
            for folder in folders:
                own, below = self._entries(folder)
                files += own
                level += below
            folders = level
        parts: list[tuple[list[str], str | None]] = [(files[i : i + PORTION], None) for i in range(0, len(files), PORTION)]
        parts += [([], f) for f in folders]
        return [_Portion(i, *p) for i, p in enumerate(parts)] or [_Portion(0, [])]

    def _walked(self, folder: str):
        own, below = self._entries(folder)
        yield from own
        for f in below:
            yield from self._walked(f)

    def read(self, partition: _Portion):
        files = partition.files if partition.folder is None else self._walked(partition.folder)
        for i, path in enumerate(files):
            try:
                with open(path, "rb") as f:
                    data = f.read()
                yield path, partition.no * PLACES + i, data.decode("utf-8", "replace"), len(data), int(os.stat(path).st_mtime * 1000)
            except OSError:
                continue


class WalkSource(DataSource):
    """``spark.read.format("walk")``: files below a path on a file system all tasks see; also those Spark hides."""

    @classmethod
    def name(cls) -> str:
        return "walk"

    def schema(self) -> str:
        return "path string, file_no bigint, text string, size bigint, modified bigint"

    def reader(self, schema) -> DataSourceReader:
        return _WalkReader(dict(self.options))


def walk(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """``path, file_no, text, size, modified`` of all files; dot entries and build folders only with ``hidden``.

    ``file_no`` grows in walking order. A missing root gives none. Roots on
    object stores are listed by Spark itself (see ``scan``).
    """
    if "://" in root and not root.startswith("file://"):
        return scan(spark, root, hidden)
    spark.dataSource.register(WalkSource)
    return spark.read.format("walk").option("hidden", str(hidden).lower()).load(root)


def scan(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """As ``walk`` for object stores and large trees: Spark's own listing, filtered below ``root``.

    ``file_no`` is drawn from the path's digest, so it orders files alike at every
    run, but not by name. Names that begin with a dot or an underscore Spark itself passes over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inner = F.regexp_replace("path", "^file:/*", "/")
    skipped = F.concat(F.lit("/"), T.relative_path(inner, root.removeprefix("file://"))).rlike(r"/(\.[^/]*|node_modules|dist|build)(/|$)")
    kept = files if hidden else files.where(~skipped)
    number = F.xxhash64(inner).bitwiseAND(F.lit((1 << 22) - 1))
    return kept.select(inner.alias("path"), number.alias("file_no"), F.decode("content", "UTF-8").alias("text"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"))


def fingerprint(files: DataFrame) -> str:
    """Size and newest change of a set of files, for staleness checks."""
    r = files.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("modified"), F.lit(0))).first()
    return f"{r[0]}:{r[1]}"


def _node(files: DataFrame, kind: str, cut: int, label: Column | None = None, metadata: Column | None = None) -> DataFrame:
    return files.select(
        F.concat(F.lit(kind + ":"), T.stable_id("path")).alias("id"), F.lit(kind).alias("node_type"), (T.base_name("path") if label is None else label).alias("label"),
        F.substring("text", 1, cut).alias("text"), "path", (F.lit("{}") if metadata is None else metadata).alias("metadata"), sessions.place().alias("ord"),
    )


def _tagged(nodes: DataFrame, whole: DataFrame, terms: int) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and the keywords of the first ``terms`` tokens of ``whole`` (``id``, ``text``, ``ord``), with their edges."""
    keywords, edges = G.tag_keywords(whole, F.slice(T.tokens("text"), 1, terms))
    return nodes.unionByName(keywords), edges


def _whole(files: DataFrame, kind: str) -> DataFrame:
    return files.select(F.concat(F.lit(kind + ":"), T.stable_id("path")).alias("id"), "text", sessions.place().alias("ord"))


def _edges(df: DataFrame, src: Column, dst: Column, kind: str) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("metadata"), F.col("ord"))


def repository_files(spark: SparkSession, root: str, url: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Project, file and keyword nodes and CONTAINS and TAGGED edges of a repository's source files."""
    return repository_nodes(walk(spark, root), root, url)


def repository_nodes(files: DataFrame, root: str, url: str | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``repository_files``, of ``files`` (``path, file_no, text``) that have been read."""
    root = root.rstrip("/")
    files = files.where(T.extension("path").isin(SOURCE_ENDINGS) & (T.filled("text")))
    origin = {"sourceURL": url} if url else {}
    nodes = _node(files, "file", REPOSITORY_CUT, T.relative_path("path", root), F.lit(json.dumps({"project": root, **origin}, ensure_ascii=False)))
    project = files.sparkSession.range(1).select(
        F.concat(F.lit("project:"), T.stable_id(F.lit(root))).alias("id"), F.lit("project").alias("node_type"), F.lit(root.rsplit("/", 1)[-1]).alias("label"), F.lit(root).alias("text"),
        F.lit(root).alias("path"), F.lit(json.dumps(origin, ensure_ascii=False)).alias("metadata"), F.lit(-1).cast("bigint").alias("ord"),
    )
    edges = _edges(nodes, F.concat(F.lit("project:"), T.stable_id(F.lit(root))), F.col("id"), "CONTAINS")
    nodes, tagged = _tagged(project.unionByName(nodes), _whole(files, "file"), FILE_TERMS)
    return nodes, edges.unionByName(tagged)


def prompt_directory(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Prompt and keyword nodes, and TAGGED edges, of the text files below a folder."""
    return prompt_nodes(walk(spark, root))


def prompt_nodes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``prompt_directory``, of files that have been read."""
    files = files.where(T.extension("path").isin(PROMPT_ENDINGS) & (T.filled("text")))
    return _tagged(_node(files, "prompt", PROMPT_CUT, metadata=F.lit('{"kind":"prompt"}')), _whole(files, "prompt"), PROMPT_TERMS)


def memory_entries(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of curated memory files, parted by a line that holds only a section sign; blank ones don't count."""
    parts = F.filter(F.transform(F.split("text", "\n§\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    target = F.when(T.base_name("path") == "USER.md", "user").otherwise("memory")
    about = F.to_json(F.struct("target", F.lit("hermes").alias("source"), F.lit("curated-memory").alias("kind"), F.col("pos").alias("index")))
    nodes = files.select("path", "file_no", target.alias("target"), F.posexplode(parts).alias("pos", "entry")).select(
        F.concat(F.lit("memory:"), T.stable_id(F.concat_ws(":", "path", F.col("pos").cast("string"), "entry"))).alias("id"), F.lit("memory").alias("node_type"), T.first_line("entry").alias("label"),
        F.col("entry").alias("text"), "path", about.alias("metadata"), sessions.place(turn=F.col("pos")).alias("ord"),
    )
    return _tagged(nodes, nodes.select("id", "text", "ord"), MEMORY_TERMS)


def filled_files(spark: SparkSession, root: str) -> DataFrame:
    """The files below ``root`` that hold anything; raises where there is no such file or folder."""
    files = walk(spark, root).where(T.filled("text"))
    if "://" not in root.removeprefix("file://") and not os.path.exists(root.removeprefix("file://")):
        raise FileNotFoundError(root)
    return files


def knowledge_path(spark: SparkSession, root: str, kind: str | None = None, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a file or folder: memory files, session exports, else documents.

    Blank files give nothing. A structured file without turns is a document.
    ``kind`` stands in a document's metadata, ``label`` takes the place of its file's name.
    """
    return knowledge_nodes(filled_files(spark, root), kind, label)


def knowledge_nodes(files: DataFrame, kind: str | None = None, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``knowledge_path``, of files that have been read."""
    files = files.where(T.filled("text"))
    memory = files.where(T.base_name("path").isin(*MEMORY_FILES))
    others = files.where(~T.base_name("path").isin(*MEMORY_FILES))
    records = sessions.parse_records(others)
    plain = others.join(sessions.session_turns(records).select("path").distinct(), "path", "left_anti")
    named = F.lit(label.strip()) if label and label.strip() else None
    about = F.to_json(F.struct(F.lit(kind or "document").alias("kind"), F.lit("import").alias("source")))
    parts = [memory_entries(memory), sessions.session_graph(records), _tagged(_node(plain, "document", DOCUMENT_CUT, named, about), _whole(plain, "document"), FILE_TERMS)]
    nodes, edges = parts[0]
    for more_nodes, more_edges in parts[1:]:
        nodes, edges = nodes.unionByName(more_nodes), edges.unionByName(more_edges)
    return nodes, edges


def recording_archive(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Recording, transcript and keyword nodes with HAS_TRANSCRIPT and TAGGED edges of completed recordings.

    Metadata is any ``.json`` file but ``graph.json``; the transcript lies beside
    it. Malformed files and blank transcripts are left out.
    """
    return recording_nodes(walk(spark, root, hidden=True))


def recording_nodes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``recording_archive``, of files that have been read."""
    v = F.col("v")
    said_in = lambda n, default: F.coalesce(F.try_variant_get(v, "$." + n, "string"), F.lit(default))
    meta = files.where((T.extension("path") == ".json") & (T.base_name("path") != "graph.json")).select("path", "file_no", "text", F.try_parse_json("text").alias("v"))
    meta = meta.where(F.schema_of_variant("v").startswith("OBJECT") & (T.variant_kind(T.variant_at(v, "sessionID")) == "STRING")).select(
        "text", sessions.place().alias("ord"), T.directory("path").alias("dir"), F.try_variant_get(v, "$.sessionID", "string").alias("sid"), F.try_variant_get(v, "$.status", "string").alias("status"),
        said_in("transcriptFilename", "transcript.txt").alias("file"), said_in("audioFilename", "audio.wav").alias("audio"), F.try_variant_get(v, "$.headline", "string").alias("headline"),
        F.try_variant_get(v, "$.summary", "string").alias("summary"), F.when(T.variant_kind(T.variant_at(v, "keywords")).startswith("ARRAY"), F.try_variant_get(v, "$.keywords", "array<string>")).alias("keywords"),
    ).where("status = 'completed'")
    said = files.select(T.directory("path").alias("dir"), T.base_name("path").alias("file"), F.col("text").alias("said"), F.col("path").alias("said_path")).where(T.filled("said"))
    both = meta.join(said, ["dir", "file"]).withColumn("label", F.coalesce("headline", T.sentence_label("said", F.col("sid"))))
    rec, tra = F.concat(F.lit("recording:"), "sid"), F.concat(F.lit("transcript:"), "sid")
    about = F.to_json(F.struct(F.col("sid").alias("sessionID"), F.lit("archive").alias("source")))
    recordings = both.select(rec.alias("id"), F.lit("recording").alias("node_type"), "label", F.coalesce("summary", "said").alias("text"), F.concat("dir", F.lit("/"), "audio").alias("path"), F.col("text").alias("metadata"), "ord")
    transcripts = both.select(tra.alias("id"), F.lit("transcript").alias("node_type"), F.concat("label", F.lit(" transcript")).alias("label"), F.col("said").alias("text"), F.col("said_path").alias("path"), about.alias("metadata"), (F.col("ord") + 1).cast(sessions.PLACE).alias("ord"))
    terms = F.coalesce("keywords", F.slice(T.tokens("said"), 1, RECORDING_TERMS))
    tagged = both.select(rec.alias("id"), "ord", terms.alias("terms")).unionByName(both.select(tra.alias("id"), (F.col("ord") + 1).cast(sessions.PLACE).alias("ord"), terms.alias("terms")))
    keywords, edges = G.tag_keywords(tagged, F.col("terms"))
    return recordings.unionByName(transcripts).unionByName(keywords), _edges(both, rec, tra, "HAS_TRANSCRIPT").unionByName(edges)


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a stored graph; a missing file is an empty graph."""
    node = "array<struct<id:string,type:string,label:string,text:string,path:string,metadata:string>>"
    edge = "array<struct<`from`:string,`to`:string,type:string,weight:double,metadata:string>>"
    if "://" not in path and not os.path.exists(path):
        whole = spark.createDataFrame([], f"nodes {node}, edges {edge}")
    else:
        whole = spark.read.schema(f"nodes {node}, edges {edge}").json(path, multiLine=True)
    nodes = whole.select(F.posexplode("nodes").alias("ord", "n")).select("n.id", F.col("n.type").alias("node_type"), "n.label", "n.text", "n.path", "n.metadata", F.col("ord").cast("bigint"))
    edges = whole.select(F.posexplode("edges").alias("ord", "e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.col("e.type").alias("edge_type"), "e.weight", "e.metadata", F.col("ord").cast("bigint"))
    return nodes, edges


def pasted_text(folder: str, text: str, label: str = "") -> str:
    """Saves a pasted text under its (and its label's) digest, for its owner only, and returns the path, for ``knowledge_path``."""
    import hashlib

    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, hashlib.sha256(f"{label}\n{text}".encode()).hexdigest()[:20] + ".txt")
    with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        f.write(text)
    return path


def language(files: DataFrame) -> str:
    """typescript with a package.json at the top, python with a pyproject.toml or requirements.txt, else generic."""
    names = T.base_name("path")
    r = files.agg(F.max(names == "package.json"), F.max(names.isin("pyproject.toml", "requirements.txt"))).first()
    return "typescript" if r[0] else "python" if r[1] else "generic"
