"""Account exports: conversations as trees of nodes, or as flat messages with parents.

Files of any size are read by their elements (see ``elements``), each a variant.  What isn't valid JSON, an element or a whole file,
gives a failure row, never silence.  Files with personal data are known by name and never opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import model
from corpusloom.operators import maintenance, threads
from corpusloom.sources import elements
from corpusloom.sources.agents import get, tool_line

# File names of exports and what they are.
PERSONAL = ("user.json", "users.json", "login_history.json")
SKIPPED = ("chat.html", "ads.json", "export_manifest.json", "conversation_asset_file_names.json", "library_files.json", "user_settings.json",
    "message_feedback.json", "shared_conversations.json")
CONVERSATIONS = r"conversations[^/]*\.json"
EXPORT_SALIENT = ("command", "file_path", "path", "query", "pattern", "url", "prompt", "description")
ASSET_NAMES = "conversation_asset_file_names.json"
ASSET_KINDS = {"image_asset_pointer": "image", "audio_asset_pointer": "audio", "real_time_user_audio_video_asset_pointer": "video"}
CONTENT_TYPES = ("text", "multimodal_text", "code", "execution_output", "thoughts", "reasoning_recap")


def survey(listing: DataFrame) -> DataFrame:
    """(path, state): parsed, personal, skipped, or unknown, which is an error to report."""
    name = F.substring_index("path", "/", -1)
    state = (
        F.when(name.isin(*PERSONAL), "personal").when(name.rlike(f"^{CONVERSATIONS}$") | (name == "memories.json") | F.col("path").rlike(r"/projects/[^/]+\.json$"), "parsed")
        .when(name.isin(*SKIPPED) | name.rlike(r"\.(dat|png|jpe?g|gif|webp|pdf|wav|mp3|mp4)$"), "skipped").otherwise("unknown")
    )
    return listing.select("path", state.alias("state"))


def batch_date(path: Column, mtime: Column) -> Column:
    """Date in a batch's name, else of an epoch in it, else of the file."""
    epoch = F.regexp_extract(path, r"(?:^|[-_/])(1[0-9]{9})(?:[0-9]{3})?(?:[-_/.]|$)", 1)
    return F.coalesce(F.nullif(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")),
        F.when(epoch != "", F.date_format(F.timestamp_seconds(epoch.cast("long")), "yyyy-MM-dd")),
        F.date_format(F.timestamp_seconds(mtime), "yyyy-MM-dd"))


def date_of(value: Column) -> Column:
    """Date of an epoch number (UTC) or of the first ten characters of a string."""
    number = value.try_cast("double")
    return F.when(number > 0, F.date_format(F.timestamp_seconds(number), "yyyy-MM-dd")).when(F.length(value) >= 10, F.substring(value, 1, 10))


def json_items(spark: SparkSession, paths: list[str] | str, inner: str | None = "conversations") -> tuple[DataFrame, DataFrame]:
    """((path, at, item), (path, at, problem)): elements of an array, of an object's array ``inner``, or the object itself."""
    return elements.elements(spark, paths, inner)


def asset_names(items: DataFrame) -> DataFrame:
    """(key, name) of assets, from the maps beside an export's conversations; of several names the last path's."""
    rows = items.select("path", F.explode(F.try_variant_get("item", "$", "map<string,string>")).alias("key", "name")).where("name is not null")
    return rows.groupBy("key").agg(F.max_by("name", "path").alias("name"))


def pointers(message: Column) -> Column:
    """Keys of the assets that a node's message points to."""
    parts = F.coalesce(F.try_variant_get(message, "$.content.parts", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    keys = F.transform(parts, lambda p: F.when(F.schema_of_variant(p).startswith("OBJECT"), F.substring_index(get(p, "asset_pointer"), "/", -1)))
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))


def with_assets(nodes: DataFrame, assets: DataFrame) -> DataFrame:
    """Nodes (conv, node, message) with ``assets``, a map of the names of what each points to; only nodes with pointers are joined."""
    asked = nodes.select("conv", "node", F.explode(pointers(F.col("message"))).alias("pointer")).withColumn("key",
        F.explode(F.array("pointer", F.concat("pointer", F.lit(".dat")))))
    held = asked.join(assets, "key").groupBy("conv", "node").agg(F.map_from_entries(F.collect_set(F.struct("key", "name"))).alias("assets"))
    return nodes.join(held, ["conv", "node"], "left")


def node_text(message: Column, assets: Column) -> Column:
    """(prose, reasoning) of a node's message by its content type; an unknown type leaves a mark."""
    content = F.try_variant_get(message, "$.content", "variant")
    kind = get(content, "content_type")
    none = F.expr("cast(array() as array<variant>)")
    thoughts = F.transform(F.coalesce(F.try_variant_get(content, "$.thoughts", "array<variant>"), none),
        lambda t: F.concat_ws("\n", F.when(F.trim(get(t, "summary")) != "", F.concat(F.lit("[thinking] "), F.trim(get(t, "summary")))),
            F.nullif(F.trim(get(t, "content")), F.lit(""))))
    reasoning = F.array_join(F.filter(thoughts, lambda s: s != ""), "\n")

    def label(part: Column) -> Column:
        pointer = get(part, "asset_pointer")
        key = F.substring_index(pointer, "/", -1)
        name = F.coalesce(F.try_element_at(assets, F.concat(key, F.lit(".dat"))), F.try_element_at(assets, key))
        what = F.coalesce(get(part, "content_type"), F.lit("asset"))
        what = F.coalesce(*(F.when(what == kind, name_) for kind, name_ in ASSET_KINDS.items()), what)
        return F.when(pointer.isNotNull(), F.concat(F.lit("["), what, F.coalesce(F.concat(F.lit(": "), name), F.lit("")), F.lit("]")))

    said = lambda s: F.when(F.trim(s) != "", s)
    parts = F.transform(F.coalesce(F.try_variant_get(content, "$.parts", "array<variant>"), none),
        lambda p: F.when(F.schema_of_variant(p).startswith("OBJECT"), F.coalesce(said(get(p, "text")), label(p))).otherwise(said(get(p, ""))))
    every = F.filter(F.concat(parts, F.array(said(get(content, "text")))), lambda s: s.isNotNull())
    strange = (F.size(every) == 0) & kind.isNotNull() & ~kind.isin(*CONTENT_TYPES)
    flat = F.when(~F.schema_of_variant(content).startswith("OBJECT"), get(content, ""))
    prose = F.when(flat.isNotNull(), flat).when(kind.isin("reasoning_recap", "thoughts"), "").otherwise(F.array_join(every, "\n"))
    more = F.when(kind == "thoughts", reasoning).when(strange, F.concat(F.lit("[unhandled content_type: "), kind, F.lit("]"))).otherwise("")
    return F.struct(prose.alias("prose"), more.alias("reasoning"))


def tree_messages(items: DataFrame, assets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(conversations, nodes) of an export whose conversations are maps of nodes with parent edges; ``assets`` has (key, name)."""
    item = F.col("item")
    stem = F.substring_index("path", "/", -1)
    rows = items.select("path", F.coalesce(get(item, "conversation_id"), get(item, "id"),
        F.concat_ws("-", stem, F.col("at").cast("string"))).alias("conv"), get(item, "title").alias("title"), get(item, "current_node").alias("head"),
        date_of(get(item, "create_time")).alias("doc_date"), F.coalesce(get(item, "update_time", "double"),
        get(item, "create_time", "double")).alias("updated"), F.try_variant_get(item, "$.mapping", "map<string,variant>").alias("mapping"))
    rows = rows.where("mapping is not null and size(mapping) > 0")
    last = maintenance.latest(rows, "conv", F.coalesce("updated", F.lit(0.0)), F.col("path"))
    node = F.col("n")
    nodes = last.select("conv", F.explode("mapping").alias("node", "n")).withColumn("message", F.try_variant_get(node, "$.message", "variant"))
    nodes = nodes.withColumn("assets", F.lit(None).cast("map<string,string>")) if assets is None else with_assets(nodes, assets)
    text = node_text(F.col("message"), F.col("assets"))
    nodes = nodes.select("conv", "node", get(node, "parent").alias("parent"),
        F.coalesce(get(node, "message.create_time", "double"), F.lit(0.0)).alias("at"), get(node, "message.author.role").alias("role"),
        text.alias("t"))
    return last.drop("mapping"), nodes.select("conv", "node", "parent", "at", "role", "t.prose", "t.reasoning")


def flat_messages(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, nodes) of an export whose conversations are lists of messages with parents."""
    item, m = F.col("item"), F.col("m")
    rows = items.select("path", F.coalesce(get(item, "uuid"), get(item, "id"),
        F.concat(F.lit("index-"), F.col("at").cast("string"))).alias("conv"), F.coalesce(get(item, "name"), get(item, "title")).alias("title"),
        get(item, "summary").alias("summary"), date_of(F.coalesce(get(item, "created_at"), get(item, "create_time"))).alias("doc_date"),
        F.coalesce(get(item, "updated_at"), get(item, "created_at"), F.lit("")).alias("updated"),
        F.coalesce(F.try_variant_get(item, "$.chat_messages", "array<variant>"),
            F.try_variant_get(item, "$.messages", "array<variant>")).alias("messages"))
    rows = rows.where("messages is not null and size(messages) > 0")
    last = maintenance.latest(rows, "conv", F.col("updated"), F.col("path"))
    none = F.expr("cast(array() as array<variant>)")
    nodes = last.select("conv", F.posexplode("messages").alias("i", "m"))
    blocks = F.coalesce(F.try_variant_get(m, "$.content", "array<variant>"), none)
    wanted = F.filter(blocks, lambda b: F.coalesce(get(b, "type"), F.lit("text")).isin("text", "thinking"))
    body = F.filter(F.transform(wanted, lambda b: F.coalesce(F.nullif(get(b, "text"), F.lit("")), get(b, "thinking"),
        F.when(~F.schema_of_variant(b).startswith("OBJECT"), get(b, "")))), lambda s: s.isNotNull() & (F.trim(s) != ""))
    prose = F.when(F.trim(get(m, "text")) != "", get(m, "text")).otherwise(F.array_join(body, "\n"))
    tools = F.transform(F.filter(blocks, lambda b: get(b, "type") == "tool_use"), lambda b: tool_line(b, EXPORT_SALIENT))
    nodes = nodes.select("conv", F.coalesce(get(m, "uuid"), F.concat(F.lit("#"), F.col("i").cast("string"))).alias("node"),
        get(m, "parent_message_uuid").alias("parent"), F.coalesce(get(m, "created_at"), F.lit("")).alias("at"), get(m, "sender").alias("role"),
        prose.alias("prose"), F.array_join(tools, "\n").alias("reasoning"))
    held = nodes.select("conv", F.col("node").alias("parent"), F.lit(True).alias("ok"))
    nodes = nodes.join(held, ["conv", "parent"], "left").withColumn("parent", F.when(F.col("ok"), F.col("parent"))).drop("ok")
    heads = nodes.groupBy("conv").agg(F.max_by("node", F.struct("at", "node")).alias("head"))
    return last.drop("messages").join(heads, "conv"), nodes


def documents(conversations: DataFrame, nodes: DataFrame, root: str) -> DataFrame:
    """(path, source_type, doc_date, title, branch, prose, events) of both branches of every conversation."""
    branch = threads.canonical(nodes.select("conv", "node", "parent"),
        conversations.where("head is not null").select("conv", F.col("head").alias("node")))
    rows = nodes.join(branch, ["conv", "node"])
    line = lambda text, role: F.when(F.trim(text) != "", F.concat_ws(": ", role, text))
    order = F.array_sort(F.collect_list(F.struct("at", "node", line(F.col("prose"), F.col("role")).alias("p"),
        line(F.col("reasoning"), F.lit(None).cast("string")).alias("r"))))
    said = rows.groupBy("conv", "branch").agg(order.alias("said"), F.count("*").alias("messages"))
    text = lambda k, sep: F.array_join(F.filter(F.transform("said", lambda s: s[k]), lambda s: s.isNotNull()), sep)
    off = F.col("branch") == model.ABANDONED
    out = said.join(conversations.select("conv", "title", "doc_date"), "conv")
    return out.select(
        F.concat(F.lit(f"{root}#conversation="), "conv", F.when(off, "&branch=abandoned").otherwise("")).alias("path"),
        F.lit(model.TRANSCRIPT).alias("source_type"), "doc_date",
        F.concat(F.coalesce("title", F.concat(F.lit("Conversation "), "conv")), F.when(off, " (abandoned branch)").otherwise("")).alias("title"),
        "branch", "messages", text("p", "\n\n").alias("prose"), text("r", "\n").alias("events"),
    ).where("prose <> '' or events <> ''")


def memory_documents(items: DataFrame, batch: str, root: str) -> DataFrame:
    """Memories as snapshots of their batch, which no later batch overwrites."""
    item, f = F.col("item"), F.col("f")
    blob = items.select(F.lit(f"{root}#batch={batch}/memories/conversations_memory").alias("path"), F.lit("Memory: conversations").alias("title"),
        date_of(get(item, "updated_at")).alias("doc_date"), get(item, "conversations_memory").alias("prose"))
    each = items.select(F.explode(F.try_variant_get(item, "$.memory_files", "array<variant>")).alias("f"))
    name = F.coalesce(get(f, "path"), get(f, "filename"), get(f, "name"), F.lit("memory"))
    file = each.select(F.concat(F.lit(f"{root}#batch={batch}/memories/"), name).alias("path"), F.concat(F.lit("Memory: "), name).alias("title"),
        date_of(get(f, "updated_at")).alias("doc_date"), F.coalesce(get(f, "content"), get(f, "text")).alias("prose"))
    return blob.union(file).where("trim(prose) <> ''").withColumn("source_type", F.lit(model.USER_MEMORY))


def project_documents(items: DataFrame, batch: str, root: str) -> DataFrame:
    """Briefs of projects and the documents attached to them, as snapshots of their batch."""
    v, d = F.col("item"), F.col("d")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.json$", "")
    rows = items.select(F.coalesce(get(v, "uuid"), stem).alias("id"), F.coalesce(get(v, "name"), stem).alias("name"),
        date_of(get(v, "created_at")).alias("doc_date"), F.concat_ws("\n\n", F.nullif(get(v, "description"), F.lit("")),
        F.nullif(get(v, "prompt_template"), F.lit(""))).alias("brief"), F.try_variant_get(v, "$.docs", "array<variant>").alias("docs"))
    at = F.concat(F.lit(f"{root}#batch={batch}/project="), "id")
    brief = rows.where("brief <> ''").select(at.alias("path"), F.concat(F.lit("Project: "), "name").alias("title"), "doc_date",
        F.concat(F.lit("# "), "name", F.lit("\n\n"), "brief").alias("prose"))
    attached = rows.select("id", "name", "doc_date", F.explode("docs").alias("d"))
    name = F.coalesce(get(d, "filename"), get(d, "uuid"), F.lit("doc"))
    each = attached.select(F.concat(at, F.lit("/doc="), name).alias("path"), F.concat_ws(": ", "name", name).alias("title"),
        F.coalesce(date_of(get(d, "created_at")), "doc_date").alias("doc_date"), get(d, "content").alias("prose"))
    return brief.union(each).where("trim(prose) <> ''").withColumn("source_type", F.lit(model.PROJECT_BRIEF))
