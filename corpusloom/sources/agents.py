"""Sessions and rollouts of coding agents, as lines of JSON of varying shape.

Lines are parsed to variants, so no schema is inferred and a malformed line is a null.  Tool output is
never read as prose: records that carry a tool result are left out, and of a tool call only its name and
salient inputs are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import model
from corpusloom.operators import sessions

# Inputs of a tool call worth keeping, and kinds of rollout payloads.
SALIENT = ("command", "file_path", "path", "pattern", "query", "url", "notebook_path", "old_string", "prompt", "description", "subagent_type")
ROLLOUT_PROSE = ("message", "agent_message", "user_message", "reasoning", "agent_reasoning")
ROLLOUT_EVENTS = ("function_call", "custom_tool_call", "exec_command_end", "patch_apply_end", "web_search_call")
ROLLOUT_META = ("session_meta", "turn_context")


def get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{path}" if path else "$", kind)


def truthy(value: Column, path: str) -> Column:
    return F.coalesce(get(value, path).isin("false", "0", "") == F.lit(False), F.lit(False))


def one_line(text: Column, limit: int = model.TOOL_INPUT_CHARS) -> Column:
    return F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, limit)


def tool_line(block: Column, salient: tuple[str, ...] = SALIENT) -> Column:
    """``[tool] name key=value …`` of a tool call."""
    said = [F.when(F.trim(one_line(get(block, f"input.{k}"))) != "", F.concat(F.lit(f"{k}="), one_line(get(block, f"input.{k}")))) for k in salient]
    return F.concat_ws(" ", F.concat(F.lit("[tool] "), F.coalesce(get(block, "name"), F.lit("tool"))), *said)


def parsed(lines: DataFrame) -> DataFrame:
    """Lines as variants; what isn't a JSON object goes."""
    return lines.withColumn("v", F.try_parse_json("value")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")


def session_records(lines: DataFrame) -> DataFrame:
    """(session, seq, …, blocks) of every record; a file without a session id is a session by its stem."""
    v = F.col("v")
    rows = parsed(lines).select(
        "path", "seq", get(v, "sessionId").alias("said"), get(v, "type").alias("type"),
        F.coalesce(get(v, "message.role"), get(v, "type")).alias("role"), get(v, "cwd").alias("cwd"), get(v, "gitBranch").alias("git_branch"),
        F.coalesce(get(v, "slug"), get(v, "customTitle")).alias("title"), get(v, "version").alias("version"), get(v, "timestamp").alias("timestamp"),
        truthy(v, "isMeta").alias("is_meta"), truthy(v, "isSidechain").alias("is_sidechain"),
        F.array_contains(F.expr("coalesce(map_keys(try_variant_get(v, '$', 'map<string,variant>')), array())"),
            "toolUseResult").alias("has_tool_result"),
        get(v, "message.content").alias("flat"), F.expr("try_variant_get(v, '$.message.content', 'array<variant>')").alias("blocks"),
    )
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    of = rows.groupBy("path").agg(sessions.first_said(F.col("said"), F.col("seq")).alias("session"))
    return rows.join(of, "path").withColumn("session", F.coalesce("session", stem)).drop("said")


def session_parts(records: DataFrame) -> DataFrame:
    """(session, path, seq, at, kind, text): prose blocks and tool headers of what is said."""
    said = sessions.messages(records)
    is_list = F.col("blocks").isNotNull()
    flat = said.where(~is_list & (F.trim("flat") != "")).select("session", "path", "seq", F.lit(0).alias("at"), F.lit(model.PROSE).alias("kind"),
        F.concat_ws(": ", "role", "flat").alias("text"))
    blocks = said.where(is_list).select("session", "path", "seq", "role", F.posexplode("blocks").alias("at", "b"))
    kind = get(F.col("b"), "type")
    body = F.when(kind == "text", get(F.col("b"), "text")).when(kind == "thinking", get(F.col("b"), "thinking"))
    prose = blocks.where(F.trim(body) != "").select("session", "path", "seq", "at", F.lit(model.PROSE).alias("kind"),
        F.concat_ws(": ", "role", body).alias("text"))
    tools = blocks.where(kind == "tool_use").select("session", "path", "seq", "at", F.lit(model.TOOL_EVENT).alias("kind"),
        tool_line(F.col("b")).alias("text"))
    return flat.union(prose).union(tools)


def joined_parts(parts: DataFrame, key: str) -> DataFrame:
    """(key, prose, events): parts in order, prose with blank lines between."""
    order = F.struct("path", "seq", "at", "text")
    rows = parts.groupBy(key).agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, order))).alias(k) for k in (model.PROSE,
        model.TOOL_EVENT)))
    text = lambda c, sep: F.array_join(F.transform(c, lambda p: p["text"]), sep)
    return rows.select(key, text(F.col(model.PROSE), "\n\n").alias("prose"), text(F.col(model.TOOL_EVENT), "\n").alias("events"))


def session_documents(lines: DataFrame) -> DataFrame:
    """One document for each session: path, doc_date, title, cwd, …, prose, events."""
    records = session_records(lines)
    seq = F.struct("path", "seq")
    stamp = F.when(F.length("timestamp") >= 10, F.col("timestamp"))
    facts = records.groupBy("session").agg(
        *(sessions.first_said(F.nullif(F.col(c), F.lit("")), seq).alias(c) for c in ("cwd", "git_branch", "title", "version")),
        F.min(stamp).alias("first_ts"), F.max(stamp).alias("last_ts"),
        F.bool_or("is_sidechain").alias("sidechain"), F.count_if("is_meta").alias("skipped_meta"), F.array_sort(F.collect_set("path")).alias("files"),
    )
    folder = F.regexp_replace(F.element_at("files", 1), r"/[^/]*$", "")
    rows = facts.join(joined_parts(session_parts(records), "session"), "session")
    return rows.select(F.concat(folder, F.lit("#session="), "session").alias("path"), F.lit(model.TRANSCRIPT).alias("source_type"),
        F.substring("first_ts", 1, 10).alias("doc_date"), F.coalesce("title",
        F.concat(F.lit("Session "), F.substring("session", 1, 8))).alias("title"), *facts.columns[:1],
        *(c for c in facts.columns[1:] if c != "title"), "prose", "events")


def wanted_rollout_lines(lines: DataFrame) -> DataFrame:
    """Lines that could matter, told by quoted markers before any parse: most bytes of a rollout are output."""
    marks = [F.col("value").contains(f'"{t}"') for t in (*ROLLOUT_PROSE, *ROLLOUT_EVENTS, *ROLLOUT_META)]
    return lines.where(reduce(lambda a, b: a | b, marks))


def payload_text(p: Column) -> Column:
    """Text of a payload from text, message, content and summary, each a string or a list of blocks."""

    def bits(key: str, inner: tuple[str, ...]) -> Column:
        blocks = F.coalesce(F.try_variant_get(p, f"$.{key}", "array<variant>"), F.expr("cast(array() as array<variant>)"))
        return F.flatten(F.transform(blocks,
            lambda b: F.filter(F.array(*(get(b, k) for k in inner), F.when(~F.schema_of_variant(b).startswith("OBJECT"), get(b, ""))),
                lambda s: s.isNotNull() & (F.trim(s) != ""))))

    flat = lambda key: F.when(F.try_variant_get(p, f"$.{key}", "array<variant>").isNull(), get(p, key))
    every = F.concat(*(F.concat(F.filter(F.array(flat(k)), lambda s: s.isNotNull() & (F.trim(s) != "")),
        bits(k, ("text", "content", "summary"))) for k in ("text", "message", "content")), bits("summary", ("text",)))
    return F.substring(F.array_join(every, "\n"), 1, model.RECORD_CHARS)


def event_line(kind: Column, p: Column) -> Column:
    command = F.coalesce(F.array_join(F.try_variant_get(p, "$.command", "array<string>"), " "), get(p, "command"), get(p, "formatted_command"),
        F.lit(""))
    code = get(p, "exit_code")
    return (
        F.when(kind.isin("function_call", "custom_tool_call"),
            F.trim(F.concat_ws(" ", F.lit("[tool]"), F.coalesce(get(p, "name"), F.lit("tool")),
                one_line(F.coalesce(get(p, "arguments"), get(p, "input"), F.lit(""))))))
        .when(kind == "exec_command_end", F.concat(F.lit("[exec] "), one_line(command),
            F.when(code.isNotNull(), F.concat(F.lit(" (exit "), code, F.lit(")"))).otherwise("")))
        .when(kind == "patch_apply_end",
            F.trim(F.concat(F.lit("[patch] "), F.substring(F.coalesce(get(p, "stdout"), F.lit("")), 1, model.TOOL_INPUT_CHARS))))
        .when(kind == "web_search_call",
            F.trim(F.concat(F.lit("[web_search] "), F.substring(F.coalesce(get(p, "query"), get(p, "action.query"), F.lit("")), 1,
                model.TOOL_INPUT_CHARS))))
    )


def rollout_documents(lines: DataFrame) -> DataFrame:
    """One document for each rollout file."""
    v, p = F.col("v"), F.col("p")
    rows = parsed(wanted_rollout_lines(lines)).select("path", "seq", get(v, "timestamp").alias("timestamp"), get(v, "type").alias("outer"),
        F.expr("variant_get(v, '$.payload', 'variant')").alias("p")).withColumn("kind", get(p, "type"))
    seq = F.col("seq")
    meta, turn = F.col("outer") == "session_meta", F.col("outer") == "turn_context"
    stamp = F.when(F.length("timestamp") >= 10, F.col("timestamp"))
    facts = rows.groupBy("path").agg(
        sessions.first_said(F.when(meta, get(p, "id")), seq).alias("session"),
        sessions.first_said(F.when(meta | turn, get(p, "cwd")), seq).alias("cwd"),
        sessions.first_said(F.when(turn, get(p, "model")), seq).alias("model"),
        sessions.first_said(F.when(meta, get(p, "cli_version")), seq).alias("version"), F.min(stamp).alias("first_ts"), F.max(stamp).alias("last_ts"),
    )
    inner = rows.where(~F.coalesce(meta, F.lit(False)) & ~F.coalesce(turn, F.lit(False)))
    text = payload_text(p)
    role = F.coalesce(get(p, "role"), F.when(F.col("kind") == "user_message", "user").when(F.col("kind") == "agent_message",
        "assistant").otherwise(F.col("kind")))
    prose = inner.where(F.col("kind").isin(*ROLLOUT_PROSE) & (F.trim(text) != "")).select("path", "seq", F.lit(0).alias("at"),
        F.lit(model.PROSE).alias("kind"), F.concat_ws(": ", role, text).alias("text"))
    events = inner.where(F.col("kind").isin(*ROLLOUT_EVENTS)).select("path", "seq", F.lit(0).alias("at"), F.lit(model.TOOL_EVENT).alias("kind"),
        event_line(F.col("kind"), p).alias("text"))
    parts = prose.union(events)
    named = F.regexp_extract(F.substring_index("path", "/", -1), r"^rollout-(.{10})", 1)
    out = facts.join(joined_parts(parts, "path"), "path")
    return out.select("path", F.lit(model.TRANSCRIPT).alias("source_type"),
        F.coalesce(F.substring("first_ts", 1, 10), F.nullif(named, F.lit(""))).alias("doc_date"), *facts.columns[1:], "prose", "events")


def with_titles(documents: DataFrame, index_lines: DataFrame) -> DataFrame:
    """Rollouts with the latest thread name of their session."""
    v = F.col("v")
    names = parsed(index_lines).select(get(v, "id").alias("session"), get(v, "thread_name").alias("_title"), get(v, "updated_at").alias("_at"))
    last = names.groupBy("session").agg(F.max_by("_title", "_at").alias("title"))
    return documents.join(last, "session", "left")
