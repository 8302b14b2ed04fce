"""Inventory operators over class, method and call-site facts: what is probeable, observable, test code, entry point or called.

Class names are internal names (``a/b/C``), annotations are descriptors (``La/b/C;``). Null flags count as false.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import kept

# They must match what builds are scanned with.
SHORT_CIRCUITING = (
    "Cacheable", "CachePut", "CacheResult", "Caching", "CircuitBreaker", "Retryable", "Recover", "HystrixCommand", "Bulkhead", "RateLimiter", "TimeLimiter", "Transactional",
)
TEST_ANNOTATIONS = (
    "Lorg/junit/Test;", "Lorg/junit/Before;", "Lorg/junit/After;", "Lorg/junit/BeforeClass;", "Lorg/junit/AfterClass;", "Lorg/junit/runner/RunWith;",
    "Lorg/junit/jupiter/api/Test;", "Lorg/junit/jupiter/api/RepeatedTest;", "Lorg/junit/jupiter/api/TestFactory;", "Lorg/junit/jupiter/api/TestTemplate;",
    "Lorg/junit/jupiter/api/Nested;", "Lorg/junit/jupiter/api/BeforeEach;", "Lorg/junit/jupiter/api/AfterEach;", "Lorg/junit/jupiter/api/BeforeAll;",
    "Lorg/junit/jupiter/api/AfterAll;", "Lorg/junit/jupiter/api/extension/ExtendWith;", "Lorg/junit/jupiter/params/ParameterizedTest;",
    "Lorg/testng/annotations/Test;", "Lorg/testng/annotations/BeforeMethod;", "Lorg/testng/annotations/AfterMethod;",
)
ENTRY_KINDS = {
    "Lorg/springframework/web/bind/annotation/RequestMapping;": "RequestMapping",
    "Lorg/springframework/web/bind/annotation/GetMapping;": "GetMapping",
    "Lorg/springframework/web/bind/annotation/PostMapping;": "PostMapping",
    "Lorg/springframework/web/bind/annotation/PutMapping;": "PutMapping",
    "Lorg/springframework/web/bind/annotation/DeleteMapping;": "DeleteMapping",
    "Lorg/springframework/web/bind/annotation/PatchMapping;": "PatchMapping",
    "Lorg/springframework/scheduling/annotation/Scheduled;": "Scheduled",
    "Lorg/springframework/context/event/EventListener;": "EventListener",
    "Lorg/springframework/kafka/annotation/KafkaListener;": "KafkaListener",
    "Lorg/springframework/amqp/rabbit/annotation/RabbitListener;": "RabbitListener",
    "Lorg/springframework/jms/annotation/JmsListener;": "JmsListener",
    "Ljavax/annotation/PostConstruct;": "PostConstruct",
    "Ljakarta/annotation/PostConstruct;": "PostConstruct",
    "Ljavax/annotation/PreDestroy;": "PreDestroy",
    "Ljakarta/annotation/PreDestroy;": "PreDestroy",
    "Lorg/springframework/context/annotation/Bean;": "Bean",
    "Ljavax/ws/rs/Path;": "Path",
    "Ljakarta/ws/rs/Path;": "Path",
    "Ljavax/ws/rs/GET;": "GET",
    "Ljakarta/ws/rs/GET;": "GET",
    "Ljavax/ws/rs/POST;": "POST",
    "Ljakarta/ws/rs/POST;": "POST",
}
CLASS_LEVEL = ("Lorg/springframework/web/bind/annotation/RequestMapping;", "Ljavax/ws/rs/Path;", "Ljakarta/ws/rs/Path;")
TRACE_ENTRIES = (
    "doFilter(Ljavax/servlet/ServletRequest;Ljavax/servlet/ServletResponse;Ljavax/servlet/FilterChain;)V",
    "doFilter(Ljakarta/servlet/ServletRequest;Ljakarta/servlet/ServletResponse;Ljakarta/servlet/FilterChain;)V",
    "service(Ljavax/servlet/ServletRequest;Ljavax/servlet/ServletResponse;)V",
    "service(Ljakarta/servlet/ServletRequest;Ljakarta/servlet/ServletResponse;)V",
    "service(Ljavax/servlet/http/HttpServletRequest;Ljavax/servlet/http/HttpServletResponse;)V",
    "service(Ljakarta/servlet/http/HttpServletRequest;Ljakarta/servlet/http/HttpServletResponse;)V",
    "doService(Ljavax/servlet/http/HttpServletRequest;Ljavax/servlet/http/HttpServletResponse;)V",
    "doService(Ljakarta/servlet/http/HttpServletRequest;Ljakarta/servlet/http/HttpServletResponse;)V",
)
GENERATED = (
    "$$EnhancerBySpringCGLIB$$", "$$EnhancerByCGLIB$$", "$$FastClassBySpringCGLIB$$", "$$SpringCGLIB$$", "$$Lambda", "GeneratedMethodAccessor",
    "GeneratedConstructorAccessor", "ByteBuddy$", "$MockitoMock$", "_$$_jvst",
)
HARD_VETOES = ("java/", "jdk/", "sun/", "com/sun/", "javax/")
SOFT_VETOES = (
    "io/opentelemetry/", "net/bytebuddy/", "org/jacoco/", "datadog/", "com/datadog/", "com/newrelic/", "com/dynatrace/", "com/appdynamics/", "org/apache/skywalking/", "org/aspectj/",
)
_ALOAD, _GETFIELD, _FIRST_RETURN, _LAST_RETURN = 25, 180, 172, 177


def _any(array: Column | str, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(array, F.array(*map(F.lit, values))), F.lit(False))


def probeable(methods: DataFrame) -> DataFrame:
    flags = [~F.coalesce(F.col(c), F.lit(False)) for c in ("is_synthetic", "is_bridge", "is_abstract", "is_native")]
    return methods.where(flags[0] & flags[1] & flags[2] & flags[3] & (F.col("name") != "<clinit>"))


def observable() -> Column:
    """Whether a probe in the body can tell anything: from its shape (n_ins, ops, invokes, ctor_invokes, is_plain)."""
    accessor = (F.col("n_ins") == 3) & (F.col("ops")[0] == _ALOAD) & (F.col("ops")[1] == _GETFIELD) & F.col("ops")[2].between(_FIRST_RETURN, _LAST_RETURN)
    delegating = (F.col("name") == "<init>") & F.col("is_plain") & (F.col("invokes") == 1) & (F.col("ctor_invokes") == 1)
    return F.when(F.col("is_abstract") | F.col("is_native") | (F.col("n_ins") <= 2), False).when(accessor | delegating, False).otherwise(True)


def simple_name(descriptor: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(descriptor, ";$", ""), r"^(.*[/$]|L)", "")


def short_circuitable(method_annotations: Column, class_annotations: Column) -> Column:
    """Whether the body may be skipped by an interceptor."""
    return _any(F.transform(F.concat(method_annotations, class_annotations), simple_name), SHORT_CIRCUITING)


def public_api(is_public: Column, cls: Column) -> Column:
    segments = F.split(F.lower(cls), "/")
    return is_public & ~_any(F.slice(segments, 1, F.size(segments) - 1), ("internal", "impl"))


def test_classes(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """classes(cls, annotations, origin) with is_test."""
    marked = methods.where(_any("annotations", TEST_ANNOTATIONS)).select("cls").distinct().withColumn("marked", F.lit(True))
    simple = F.regexp_extract("cls", r"([^/]*)$", 1)
    named = simple.endswith("Test") | simple.endswith("Tests") | simple.endswith("IT") | simple.startswith("Test")
    origin = F.translate("origin", "\\", "/")
    placed = origin.contains("/src/test/") | F.array_contains(F.split(origin, "/"), "test-classes")
    return classes.join(marked, "cls", "left").withColumn("is_test", F.coalesce("marked", F.lit(False)) | _any("annotations", TEST_ANNOTATIONS) | named | placed).drop("marked")


def _kind(descriptor: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in ENTRY_KINDS.items() for x in pair])[descriptor]


def entry_points_annotated(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(cls, name, desc, kind, propagated) of methods marked themselves, or public members of a marked class."""
    usable = methods.where("not is_synthetic and not is_bridge and name <> '<clinit>'")
    own = usable.select("cls", "name", "desc", F.explode("annotations").alias("a")).select("cls", "name", "desc", _kind(F.col("a")).alias("kind"), F.lit(False).alias("propagated"))
    marked = classes.select("cls", F.explode("annotations").alias("a")).where(F.col("a").isin(*CLASS_LEVEL)).select("cls", _kind(F.col("a")).alias("kind"))
    handed = usable.where("is_public and name <> '<init>'").join(marked, "cls").select("cls", "name", "desc", "kind", F.lit(True).alias("propagated"))
    return own.where("kind is not null").unionByName(handed).distinct()


def entry_points_main(methods: DataFrame) -> DataFrame:
    return methods.where("is_public and is_static and name = 'main' and desc = '([Ljava/lang/String;)V'").select("cls", "name", "desc", F.lit("main").alias("kind"))


def entry_points_services(providers: DataFrame) -> DataFrame:
    """providers(cls): their constructors, whether or not the class was scanned."""
    return providers.select("cls", F.lit("<init>").alias("name"), F.lit("()V").alias("desc"), F.lit("ServiceLoader").alias("kind")).distinct()


def boundary_fault(spec: Column) -> Column:
    """Why a boundary ``type#name(desc)ret`` can't be used; null if it can."""
    parts = F.split(spec, "#")
    return (
        F.when(F.size(parts) != 2, "needs exactly one #").when(F.trim(parts[0]) == "", "no type").when(~parts[1].contains("("), "no descriptor")
        .when(parts[1].startswith("("), "no name").when(~parts[1].rlike(r"^[^()]+\([^()]*\)[^()]+$"), "bad descriptor")
    )


def entry_points_boundary(subtypes: DataFrame, methods: DataFrame, specs: DataFrame) -> DataFrame:
    """Own concrete methods of subtypes(ancestor, ref) that match specs(place, spec); the first spec that matches is the kind.

    In a descriptor ``*`` stands for one reference type. specs is a small configuration table.
    """
    parts, signature = F.split("spec", "#"), F.split("spec", "#")[1]
    wanted = specs.where(boundary_fault(F.col("spec")).isNull()).select(
        "place", "spec", parts[0].alias("ancestor"), F.regexp_extract(signature, r"^([^(]+)", 1).alias("name"),
        F.concat(F.lit("^"), F.replace(F.regexp_replace(F.regexp_extract(signature, r"(\(.*)$", 1), r"([()\[$.])", r"\\$1"), F.lit("*"), F.lit("L[^;]+;")), F.lit("$")).alias("shape"),
    )
    below = subtypes.join(F.broadcast(wanted), "ancestor").select(F.col("ref").alias("cls"), "place", "spec", "name", "shape")
    own = methods.where("not is_abstract and not is_static")
    met = own.join(below, ["cls", "name"]).where(F.call_function("rlike", F.col("desc"), F.col("shape")))
    return met.groupBy("cls", "name", "desc").agg(F.min_by("spec", "place").alias("kind"))


def resolve_edges(sites: DataFrame, classes: DataFrame, methods: DataFrame, subtypes: DataFrame) -> DataFrame:
    """(src, dst_cls, dst_name, dst_desc, resolution, semantics) of sites(src, kind, owner, name, desc), each edge once.

    A virtual call on a scanned class goes to the declared target and to every subtype that declares the method itself.
    """
    scanned = classes.select(F.col("cls").alias("owner")).distinct().withColumn("scanned", F.lit(True))
    virtual = F.col("kind").isin("virtual", "interface")
    get_class = (F.col("owner") == "java/lang/Object") & (F.col("name") == "getClass") & (F.col("desc") == "()Ljava/lang/Class;")
    typed = F.col("kind").isin("instanceof", "class_literal", "catch")
    resolution = (
        F.when(F.col("kind").isin("static", "special", "lambda") | typed, "exact").when(F.col("kind") == "opaque", "unresolved")
        .when(get_class | F.col("scanned").isNull(), "unresolved").otherwise("cha")
    )
    placed = sites.join(scanned, "owner", "left").withColumns({"resolution": resolution, "semantics": F.when(typed | (virtual & get_class), "noop").otherwise("blocking")})
    direct = placed.select("src", F.col("owner").alias("dst_cls"), F.col("name").alias("dst_name"), F.col("desc").alias("dst_desc"), "resolution", "semantics")
    declared = methods.select(F.col("cls").alias("ref"), "name", "desc").distinct()
    over = placed.where(virtual & (F.col("resolution") == "cha")).select("src", "owner", "name", "desc").distinct()
    over = over.join(subtypes.select(F.col("ancestor").alias("owner"), "ref"), "owner").join(declared, ["ref", "name", "desc"])
    over = over.select("src", F.col("ref").alias("dst_cls"), F.col("name").alias("dst_name"), F.col("desc").alias("dst_desc"), F.lit("cha").alias("resolution"), F.lit("blocking").alias("semantics"))
    return direct.unionByName(over).distinct()


def glob_regex(pattern: str) -> str:
    """A class pattern as a regular expression: * inside a segment, ** over segments, **. over none as well."""
    out, at = [], 0
    while at < len(pattern):
        for mark, regex in (("**.", r"(?:[^.]+\.)*"), ("**", ".*"), ("*", "[^.]*")):
            if pattern.startswith(mark, at):
                out.append(regex)
                at += len(mark)
                break
        else:
            out.append(re.escape(pattern[at]))
            at += 1
    return f"^{''.join(out)}$"


def matches(pattern: str, cls: Column, name: Column) -> Column:
    """``class#method`` or ``class``; dots between segments; a method of * is any."""
    of, _, method = pattern.partition("#")
    fits = F.translate(cls, "/", ".").rlike(glob_regex(of))
    return fits if method in ("", "*") else fits & name.rlike(glob_regex(method))


def select_timed(methods: DataFrame, entries: DataFrame, includes: list[str], excludes: list[str]) -> DataFrame:
    """Probeable, observable methods outside tests with the reason why they are timed: entry points, then the first include, less excludes."""
    best = entries.groupBy("cls", "name", "desc").agg(F.min(F.struct("propagated", "kind"))["kind"].alias("kind"))
    eligible = probeable(methods).where(observable() & ~F.col("is_test")).join(best, ["cls", "name", "desc"], "left")
    cls, name = F.col("cls"), F.col("name")
    reason = F.coalesce(F.concat(F.lit("entry:"), "kind"), *[F.when(matches(p, cls, name), F.lit(f"include:{p}")) for p in includes])
    chosen = eligible.withColumn("reason", reason).where("reason is not null").drop("kind")
    for p in excludes:
        chosen = chosen.where(~matches(p, cls, name))
    return chosen


def budget(selected: DataFrame, most: int = 250, listed: int = 5) -> tuple[bool, DataFrame]:
    """Whether the selection is within the budget, and its largest reasons."""
    reasons = selected.groupBy("reason").agg(F.count("*").alias("methods"))
    total = reasons.agg(F.sum("methods")).first()[0] or 0
    return total <= most, reasons.orderBy(F.desc("methods"), "reason").limit(listed)


def unmatched(patterns: list[str], methods: DataFrame) -> DataFrame:
    """(pattern): those that no method matches. One pass over methods, whatever the number of patterns."""
    cls, name = F.col("cls"), F.col("name")
    hits = methods.agg(*[F.bool_or(matches(p, cls, name)).alias(str(i)) for i, p in enumerate(patterns)])
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.coalesce(F.col(str(i)), F.lit(False)).alias("hit")) for i, p in enumerate(patterns)]))
    return hits.select(rows.alias("x")).where("not x.hit").select("x.pattern")


def _coloured(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ref, colour): the smallest node that reaches each node over edges(src, dst)."""
    colour = kept(nodes.select("ref", F.col("ref").alias("colour")))
    while True:
        into = edges.join(colour, F.col("src") == F.col("ref")).groupBy(F.col("dst").alias("ref")).agg(F.min("colour").alias("from_in"))
        new = kept(colour.join(into, "ref", "left").select("ref", F.least("colour", F.coalesce("from_in", "colour")).alias("colour"), (F.col("from_in") < F.col("colour")).alias("moved")))
        colour = new.select("ref", "colour")
        if new.where("moved").isEmpty():
            return colour


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ref, component): the smallest member of each node's strongly connected component over edges(src, dst).

    Nodes without an edge in or out among those left are components of their own and go first. The rest take the smallest
    node that reaches them as colour; a colour's component is what reaches its first node back inside the colour.
    """
    left, links = kept(nodes.select("ref").distinct()), kept(edges.select("src", "dst").where("src <> dst").distinct())
    links = kept(links.join(left, links["src"] == left["ref"], "left_semi").join(left, links["dst"] == left["ref"], "left_semi"))
    out = []
    while True:
        both = kept(links.select(F.col("src").alias("ref")).distinct().join(links.select(F.col("dst").alias("ref")).distinct(), "ref", "left_semi"))
        out.append(kept(left.join(both, "ref", "left_anti").select("ref", F.col("ref").alias("component"))))
        if both.isEmpty():
            break
        trimmed = kept(links.join(both, links["src"] == both["ref"], "left_semi").join(both, links["dst"] == both["ref"], "left_semi"))
        if out[-1].isEmpty():
            colour = _coloured(both, trimmed)
            inside = trimmed.join(colour.select(F.col("ref").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("ref").alias("dst"), F.col("colour").alias("c2")), "dst")
            back = kept(inside.where("c1 = c2").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            found = frontier = kept(colour.where("ref = colour").select("ref"))
            while not frontier.isEmpty():
                step = back.join(frontier, back["src"] == frontier["ref"], "left_semi").select(F.col("dst").alias("ref")).distinct()
                frontier = kept(step.join(found, "ref", "left_anti"))
                found = kept(found.union(frontier))
            out.append(kept(colour.join(found, "ref", "left_semi").select("ref", F.col("colour").alias("component"))))
            both = kept(both.join(found, "ref", "left_anti"))
            trimmed = kept(trimmed.join(both, trimmed["src"] == both["ref"], "left_semi").join(both, trimmed["dst"] == both["ref"], "left_semi"))
        left, links = both, trimmed
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def test_only(methods: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """methods(ref, is_test, is_entry) with test_only: true, false, or null where nothing can be said.

    Blocking edges(src, dst) only; members(ref, component). The first rule that fits decides: test code, entry point, no
    caller, a caller outside the component that is no test, callers in tests or in a component with tests, none of these.
    """
    known = kept(methods.join(members, "ref"))
    tested = known.groupBy("component").agg(F.bool_or("is_test").alias("has_test"))
    known = kept(known.join(tested, "component"))
    side = lambda x: known.select(F.col("ref").alias(x), F.col("is_test").alias(f"{x}_test"), F.col("component").alias(f"{x}_in"))
    inbound = edges.select("src", "dst").distinct().join(side("src"), "src").join(side("dst"), "dst").groupBy(F.col("dst").alias("ref")).agg(
        F.bool_or("src_test").alias("from_test"), F.bool_or(~F.col("src_test") & (F.col("src_in") != F.col("dst_in"))).alias("from_outside")
    )
    ruled = (
        F.when(F.col("is_test"), True).when(F.col("is_entry"), False).when(F.col("from_test").isNull(), F.lit(None)).when(F.col("from_outside"), False)
        .when(F.col("from_test") | F.col("has_test"), True).otherwise(F.lit(None))
    )
    return known.join(inbound, "ref", "left").select("ref", ruled.cast("boolean").alias("test_only"))


def trace_entry(name: Column, desc: Column, extra: list[str] | None = None) -> Column:
    return F.concat(name, desc).isin(*TRACE_ENTRIES, *[x.strip() for x in extra or [] if x.strip()])


def generated(cls: Column) -> Column:
    found = cls.rlike(r"\$Proxy\d+$")
    for marker in GENERATED:
        found = found | cls.contains(marker)
    return found


def _longest(cls: Column, prefixes: tuple[str, ...] | list[str]) -> Column:
    """Length of the longest prefix that fits, without a slash at its end; null if none does."""
    return F.array_max(F.array(F.lit(None).cast("int"), *[F.when(cls.startswith(p), len(p.rstrip("/"))) for p in prefixes]))


def in_scope(cls: Column, include: list[str], exclude: list[str]) -> Column:
    """Nothing unless included; excludes and hard vetoes win, soft ones lose to an include that is as specific."""
    included, soft = _longest(cls, include), _longest(cls, SOFT_VETOES)
    return included.isNotNull() & _longest(cls, exclude).isNull() & _longest(cls, HARD_VETOES).isNull() & (soft.isNull() | (included >= soft))


def scope_overlap(a: list[str], b: list[str]) -> list[str]:
    """The narrower of each two prefixes of which one covers the other."""
    return sorted({x if x.startswith(y) else y for x in a for y in b if x.startswith(y) or y.startswith(x)})
