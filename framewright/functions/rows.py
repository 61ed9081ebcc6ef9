"""Column builders over several columns of a record: alias picks, keys, hash buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.text import first_nonblank, first_nonempty, trim_ws

MAX_BUCKET = 4294967295.0


def pick_question_id(*aliases: Column) -> Column:
    """First alias that is neither NULL nor empty; ``0`` and blanks are kept."""
    return first_nonempty(*aliases)


def pick_video_id(*aliases: Column) -> Column:
    """First alias that is not blank, stripped; the empty string where there is none."""
    return F.coalesce(first_nonblank(*aliases), F.lit(""))


def pick_category(*aliases: Column) -> Column:
    return F.coalesce(first_nonblank(*aliases), F.lit("unknown"))


def pick_solution(solution: Column, answer: Column) -> Column:
    return F.coalesce(first_nonempty(solution, answer), F.lit(""))


def reasoning_label(*aliases: Column) -> Column:
    """First alias that is not empty, stripped, in upper case; empty where there is none."""
    return F.upper(trim_ws(F.coalesce(first_nonempty(*aliases), F.lit(""))))


def stable_key(video_id: Column, question_id: Column, *rest: Column) -> Column:
    """``video::question``, else whichever is there, else the remaining columns as one JSON object."""
    return F.coalesce(F.concat(video_id, F.lit("::"), question_id), video_id, question_id, F.to_json(F.struct(*rest)) if rest else F.lit("{}"))


def hash_bucket(key: Column, seed: int = 42) -> Column:
    """First 32 bits of SHA-256 of ``seed::key``."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}::"), key), 256), 1, 8), 16, 10).cast("bigint")


def in_eval(key: Column, fraction: float, seed: int = 42) -> Column:
    return hash_bucket(key, seed) / F.lit(MAX_BUCKET) < F.lit(fraction)


def sample_order(seed: int, *ids: Column) -> Column:
    return F.sha2(F.concat_ws("::", F.lit(str(seed)), *[i.cast("string") for i in ids]), 256)


def resolve_fields(instruction: Column, extra: Column, output: Column, problem: Column, context: Column, solution: Column, answer: Column) -> Column:
    """Struct of instruction, input and output; a missing one of the pair falls back to problem and solution together.

    NULL where neither pair is complete.
    """
    i, x, o = (trim_ws(F.coalesce(c, F.lit(""))) for c in (instruction, extra, output))
    p, k = (trim_ws(F.coalesce(c, F.lit(""))) for c in (problem, context))
    s = F.coalesce(F.nullif(trim_ws(F.coalesce(solution, F.lit(""))), F.lit("")), trim_ws(F.coalesce(answer, F.lit(""))))
    own = (i != "") & (o != "")
    spare = (p != "") & (s != "")
    made = F.struct(F.when(own, i).otherwise(p).alias("instruction"), F.when(own | (x != ""), x).otherwise(k).alias("input"), F.when(own, o).otherwise(s).alias("output"))
    return F.when(own | spare, made)


def rename_prefix(key: Column, prefixes: list[tuple[str, str]]) -> Column:
    """Replace the first prefix of the list that matches."""
    out = None
    for bad, good in prefixes:
        made = F.concat(F.lit(good), F.substr(key, F.lit(len(bad) + 1)))
        out = F.when(F.startswith(key, F.lit(bad)), made) if out is None else out.when(F.startswith(key, F.lit(bad)), made)
    return key if out is None else out.otherwise(key)


# Key parts that are rewritten in adapter weights, in order, and the second list for merger keys only.
ADAPTER_PARTS = [
    (".model.model.language_model.layers.", ".model.model.layers."),
    (".model.model.visual.blocks.", ".model.visual.blocks."),
    (".model.model.visual.merger.", ".model.visual.merger."),
]
MERGER_PARTS = [("lora_A.weight", "lora_A.default.weight"), ("lora_B.weight", "lora_B.default.weight")]


def replace_parts(key: Column, parts: list[tuple[str, str]]) -> Column:
    for old, new in parts:
        key = F.replace(key, F.lit(old), F.lit(new))
    return key


def adapter_key(key: Column) -> Column:
    """The key of an adapter weight as the merged model names it."""
    k = replace_parts(key, ADAPTER_PARTS)
    return F.when(F.contains(k, F.lit(".visual.merger.")), replace_parts(k, MERGER_PARTS)).otherwise(k)


def strip_wrapper(key: Column, prefix: str | None = None) -> Column:
    """The key without ``prefix``, or else without the wrapper's own prefix, where it starts with one."""
    cut = lambda p: F.substr(key, F.lit(len(p) + 1))
    plain = F.when(F.startswith(key, F.lit("base_model.")), cut("base_model.")).otherwise(key)
    return F.when(F.startswith(key, F.lit(prefix)), cut(prefix)).otherwise(plain) if prefix else plain


def is_quantiser_key(key: Column) -> Column:
    """Whether a key holds a quantiser's metadata, which other loaders don't take."""
    return F.endswith(key, F.lit(".SCB")) | F.endswith(key, F.lit(".weight_format")) | F.contains(key, F.lit(".SCB."))


def nested_pick(record: Column, fields: list[str], default: str) -> Column:
    """First field of a struct or map that is neither NULL nor empty, stripped; a default where there is none."""
    return trim_ws(F.coalesce(*[F.nullif(record[f], F.lit("")) for f in fields], F.lit(default)))


def chat_turns(system: str, text: Column, n_images: Column) -> Column:
    """A system turn and a user turn of image places followed by the text."""
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.cast("string").alias("text"))
    images = F.array_repeat(part("image", F.lit(None)), F.greatest(n_images, F.lit(0)))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.array(part("text", F.lit(system)))), turn("user", F.concat(images, F.array(part("text", text)))))


def rebuild_places(turns: Column, n_images: Column, fallback: Column) -> Column:
    """The user turn again with as many image places as images were kept; text from its first text part."""
    content = F.element_at(turns, -1)["content"]
    text = F.coalesce(F.get(F.filter(content, lambda c: c["type"] == "text"), F.lit(0))["text"], fallback)
    return chat_turns("", text, n_images)[1]
