"""What the built-in operators can't say: method resolution orders and type strings, as Arrow-batched Python over small
groups; and greedy walks over thought graphs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cut import cut


def dfs_order(start: str, parents: dict[str, list[str]]) -> list[str]:
    """Pre-order over parents, each class once."""
    out, seen, todo = [], set(), [start]
    while todo:
        c = todo.pop()
        if c in seen:
            continue
        seen.add(c)
        out.append(c)
        todo += reversed(parents.get(c, []))
    return out


def c3_order(start: str, parents: dict[str, list[str]]) -> list[str]:
    """C3 linearisation; where no head is free the first one is taken, and a class inside its own ancestry counts once."""
    done: dict[str, list[str]] = {}
    todo, open_ = [(start, False)], set()
    while todo:
        c, ready = todo.pop()
        if c in done:
            continue
        if not ready:
            open_.add(c)
            todo.append((c, True))
            todo += [(p, False) for p in parents.get(c, []) if p not in done and p not in open_]
            continue
        open_.discard(c)
        own = [p for p in parents.get(c, []) if p != c]
        lists = [list(done.get(p, [p])) for p in own] + [list(own)]
        out = [c]
        lists = [x for x in lists if x]
        while lists:
            head = next((x[0] for x in lists if not any(x[0] in y[1:] for y in lists)), lists[0][0])
            if head not in out:
                out.append(head)
            lists = [y for y in ([z for z in x if z != head] for x in lists) if y]
        done[c] = out
    return done[start]


def method_resolution(heritage: DataFrame, kind: str = "dfs") -> DataFrame:
    """heritage(group, child, parent, seq) -> group, cls, place, ancestor.  A group holds one hierarchy (for instance a connected
    component of it), the unit that goes to one task."""
    order = dfs_order if kind == "dfs" else c3_order

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["child", "seq"])
        parents: dict[str, list[str]] = {}
        for c, p in zip(d["child"], d["parent"], strict=True):
            parents.setdefault(c, []).append(p)
        g = d["group"].iloc[0]
        rows = [(g, c, i, a) for c in sorted(parents) for i, a in enumerate(order(c, parents))]
        return pd.DataFrame(rows, columns=["group", "cls", "place", "ancestor"])

    kind_ = heritage.schema["group"].dataType.simpleString()
    return heritage.groupBy("group").applyInPandas(run, f"`group` {kind_}, cls string, place int, ancestor string")


def split_top(s: str, sep: str = ",") -> list[str]:
    """Parts at separators outside all brackets."""
    out, depth, now = [], 0, ""
    for ch in s:
        depth += (ch in "<([{") - (ch in ">)]}")
        if ch == sep and depth == 0:
            out.append(now.strip())
            now = ""
        else:
            now += ch
    return [x for x in [*out, now.strip()] if x]


#: Names that wrap an optional and an array type.  Fixed values.
OPTIONAL_WRAPS = ("Optional", "Option", "Nullable")
ARRAY_WRAPS = ("List", "list", "Array", "Vec", "Set", "Sequence", "Iterable", "ArrayList", "Collection")


def parse_type(text: str | None, language: str | None = None) -> dict:
    """name, args, is_optional, is_array of a type string."""
    s = (text or "").strip()
    optional = array = False
    while s:
        if s.endswith(("?", "!")):
            optional |= s[-1] == "?"
            s = s[:-1].strip()
        elif s.startswith(("&", "*")):
            optional |= s[0] == "*" and language in ("go", "c", "cpp")
            s = s[1:].strip()
        elif s.endswith("[]"):
            array, s = True, s[:-2].strip()
        elif s.startswith("[]"):
            array, s = True, s[2:].strip()
        elif s.startswith("[") and s.endswith("]") and ":" not in s:
            array, s = True, s[1:-1].strip()
        elif len(union := split_top(s, "|")) > 1:
            kept = [u for u in union if u not in ("None", "null", "undefined", "nil")]
            optional |= len(kept) < len(union)
            if len(kept) != 1:
                return {"name": " | ".join(kept), "args": [], "is_optional": optional, "is_array": array}
            s = kept[0]
        else:
            break
    at = min((i for i in (s.find("<"), s.find("[")) if i > 0), default=-1)
    name, args = (s[:at].strip(), split_top(s[at + 1 : -1])) if at > 0 and s[-1] in ">]" else (s, [])
    short = name.split(".")[-1].split("::")[-1]
    if short in OPTIONAL_WRAPS and args:
        inner = parse_type(args[0], language)
        return {**inner, "is_optional": True, "is_array": inner["is_array"] or array}
    return {"name": name, "args": args, "is_optional": optional, "is_array": array or short in ARRAY_WRAPS}


TYPE_PARTS = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("args", T.ArrayType(T.StringType())), T.StructField("is_optional", T.BooleanType()), T.StructField("is_array", T.BooleanType())]
)


@F.pandas_udf(TYPE_PARTS)
def type_parts(text: pd.Series, language: pd.Series) -> pd.DataFrame:
    rows = [parse_type(t, g) for t, g in zip(text, language, strict=True)]
    return pd.DataFrame(rows, columns=["name", "args", "is_optional", "is_array"])


def best_thought_path(thoughts: DataFrame, root: str, threshold: float = 0.7, max_steps: int = 50) -> DataFrame:
    """thoughts(id, parent, confidence): prune what is under 0.8 of the threshold (the root stays), then walk from the root to the
    most confident child each time: place, id."""
    kept = cut(thoughts.where((F.col("confidence") >= 0.8 * threshold) | (F.col("id") == root)))
    w = Window.partitionBy("parent").orderBy(F.desc("confidence"), "id")
    best = cut(kept.where("parent IS NOT NULL").withColumn("k", F.row_number().over(w)).where("k = 1").select("parent", "id"))
    front = cut(kept.where(F.col("id") == root).select(F.lit(0).alias("place"), "id"))
    out = front
    for i in range(1, max_steps):
        front = cut(front.join(best.withColumnRenamed("id", "next"), front["id"] == best["parent"]).select(F.lit(i).alias("place"), F.col("next").alias("id")))
        if front.isEmpty():
            break
        out = out.union(front)
    return out


def match_templates(prompts: DataFrame, templates: DataFrame, most: int = 3, fallback: int = 2) -> DataFrame:
    """prompts(prompt_id, text), templates(template_id, category, success): those whose category stands in the prompt, else the most
    successful; at most ``most`` of each.  Templates are a small registry."""
    hit = prompts.join(templates, F.contains(F.lower("text"), F.lower("category")))
    none = prompts.join(hit.select("prompt_id").distinct(), "prompt_id", "left_anti")
    top = templates.orderBy(F.desc("success"), "template_id").limit(fallback)
    every = hit.select("prompt_id", "template_id", "success").unionByName(none.join(F.broadcast(top)).select("prompt_id", "template_id", "success"))
    w = Window.partitionBy("prompt_id").orderBy(F.desc("success"), "template_id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("prompt_id", "rank", "template_id")


def with_encoder(texts: DataFrame, encode, column: str = "text", dims: int = 384) -> DataFrame:
    """Embeddings by a pluggable encoder: ``encode(list of texts) -> list of vectors``, called for Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([[float(x) for x in v] for v in encode(b.fillna("").tolist())])

    return texts.withColumn("embedding", run(F.col(column)))
