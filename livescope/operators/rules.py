"""Suppression rules as rows: parsed, derived, composed in layers, and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inventory import match_rules, parse_rule

#: Order in which layers are asked.
LAYERS = ("user", "derived", "default")


def parse_rules(lines: DataFrame) -> DataFrame:
    """lines(line_no, line) as class, method and descriptor globs; a number sign opens a comment at the start or after a space."""
    comment = F.regexp_extract("line", r"(?:^|\s)#(.*)$", 1)
    rule = F.trim(F.regexp_replace("line", r"(^|\s)#.*$", ""))
    cls = F.substring_index(rule, "#", 1)
    rest = F.when(F.contains(rule, F.lit("#")), F.regexp_extract(rule, "#(.*)$", 1)).otherwise(F.lit(""))
    name = F.substring_index(rest, "(", 1)
    desc = F.when(F.contains(rest, F.lit("(")), F.regexp_extract(rest, r"(\(.*)$", 1))
    star = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("*"))
    return lines.where(rule != "").select(
        "line_no", star(cls).alias("class_glob"), star(name).alias("method_glob"), star(desc).alias("desc_glob"), F.trim(comment).alias("comment")
    )


def derived_rules(classes: DataFrame) -> DataFrame:
    """classes(cls, annotations, members): one rule for a generated class, else one for each generated member."""
    generated = F.exists("annotations", lambda a: F.element_at(F.split(a, r"\."), -1) == "Generated")
    whole = classes.where(generated).select("cls", F.lit("*").alias("method_glob"))
    members = classes.where(~generated).select("cls", F.explode("members").alias("m")).where("m.generated").select("cls", F.col("m.name").alias("method_glob"))
    return whole.union(members)


def compose(layers: dict[str, DataFrame], defaults: bool = True) -> DataFrame:
    """Rules of all layers with their place: user first, then derived, then defaults unless these are off."""
    out = None
    for place, layer in enumerate(LAYERS):
        if layer in layers and (defaults or layer != "default"):
            own = layers[layer].withColumns({"origin": F.lit(layer), "layer": F.lit(place)})
            out = own if out is None else out.unionByName(own)
    return out


def counts_by_origin(rules: DataFrame) -> DataFrame:
    return rules.groupBy("origin").agg(F.count("*").alias("rules"))


# Members that compilers and code generators write, as class#method(desc).
DEFAULT_RULES = (
    "*#values()[L*;",
    "*#valueOf(Ljava/lang/String;)L*;",
    "*#equals(Ljava/lang/Object;)Z",
    "*#hashCode()I",
    "*#toString()Ljava/lang/String;",
    "*#canEqual(Ljava/lang/Object;)Z",
    "*#builder()L*;",
    "*#toBuilder()L*;",
    "*$*Builder#*",
)


def default_rules() -> list[tuple[str, str, str]]:
    """Class, method and descriptor globs of the default list."""
    return [parse_rule(line)[:3] for line in DEFAULT_RULES]


def suppress(methods: DataFrame, user: list[str], derived: DataFrame, defaults: bool = True) -> DataFrame:
    """methods with suppression: pattern, origin and comment of the first rule that matches, or null.

    The user's lines are asked first, then derived(cls, method_glob) of generated classes and members, then the default list.
    """

    def said(lines: list[str], origin: str):
        parsed = [(line, parse_rule(line)) for line in lines]
        kept = [(cls + "#" + name + ("" if desc == "*" else desc), (cls, name, desc), comment) for _, p in parsed if p for cls, name, desc, comment in [p]]
        texts = F.array(*[F.lit(f"{pattern} ({origin})" + (f": {comment}" if comment else "")) for pattern, _, comment in kept]) if kept else F.array().cast("array<string>")
        return [globs for _, globs, _ in kept], texts

    user_globs, user_texts = said(user, "user")
    default_globs, default_texts = said(list(DEFAULT_RULES) if defaults else [], "default")
    whole = derived.where("method_glob = '*'").select("cls", F.lit(True).alias("whole_class")).distinct()
    member = derived.where("method_glob <> '*'").select("cls", F.col("method_glob").alias("name"), F.lit(True).alias("one_member")).distinct()
    asked = match_rules(methods, user_globs).withColumnRenamed("rule_no", "user_no")
    asked = match_rules(asked, default_globs).withColumnRenamed("rule_no", "default_no")
    asked = asked.join(whole, "cls", "left").join(member, ["cls", "name"], "left")
    generated = F.when(F.col("whole_class"), F.concat("cls", F.lit("#* (derived)"))).when(F.col("one_member"), F.concat("cls", F.lit("#"), "name", F.lit(" (derived)")))
    found = F.coalesce(F.get(user_texts, F.col("user_no")), generated, F.get(default_texts, F.col("default_no")))
    return asked.withColumn("suppression", found).drop("user_no", "default_no", "whole_class", "one_member")
