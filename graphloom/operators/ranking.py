"""Search: intents, concepts, scores of symbols, files and calls, and the searches made of them.

A query is text the driver has; what it asks for becomes literals of one column expression, so that a search is a scan with
an aggregate or a top-k, without a candidate window: every row is scored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .relational import contains_text, facets, page

#: What a role, a kind and a file's role add to a score.
SYMBOL_ROLE = {"main_source": 10, "test_source": -8, "mock_source": -10, "resource_config": -12, "build_config": -15, "generated": -12, "external_stub": -14, "vendored": -20}
KIND = {18: ("class", "interface", "enum", "record", "annotation", "struct", "type"), 10: ("method", "constructor", "function"), 5: ("field", "property", "enum_constant", "constant")}
ROLE_RANK = {"main_source": 100, "resource_config": 80, "build_config": 75, "test_source": 60, "mock_source": 45, "generated": 30, "external_stub": 20, "vendored": 5}
#: Points of a concept by a name, an annotation, a role, for a file that holds one, and in all.
BY_NAME, BY_ANNOTATION, BY_ROLE, BY_FILE, CONCEPT_CAP = 72, 48, 34, 55, 100


@dataclass(frozen=True)
class Concept:
    """A concern that a question names (``trigger``) and the names, annotations and roles of the code for it."""

    id: str
    trigger: str
    names: str
    annotations: str
    roles: tuple[str, ...]
    like: tuple[str, ...]


#: The concepts.
CONCEPTS = (
    Concept(
        "auth", r"\b(authentication|authenticate|authenticated|authorization|authorize|authorized|auth|login|log[- ]?in|logout|log[- ]?out|sign[- ]?in|sign[- ]?out|signin|signout|credential|credentials|principal|security|secured|permission|permissions|access[- ]?control|current[- ]?user|logged[- ]?in|jwt|oauth|bearer[- ]?token|session)\b",
        r"(authoriz|authentic|\bauth\b|security|secured|login|logout|signin|signout|credential|principal|currentuser|userdetails|userfetcher|jwt|oauth|bearer|permission|accesscontrol|loginuser)",
        r"^(PreAuthorize|PostAuthorize|Secured|RolesAllowed|DenyAll|PermitAll|EnableWebSecurity|EnableGlobalMethodSecurity|EnableMethodSecurity|AuthenticationPrincipal|WithMockUser|WithUserDetails)$", ("spring:security",),
        ("authoriz", "authentic", "security", "login", "logout", "credential", "principal", "currentuser", "userdetails", "oauth", "permission"),
    ),
    Concept(
        "transaction", r"\b(transaction|transactional|transactions|commit|committed|rollback|rolled[- ]?back|atomic|atomicity|unit[- ]?of[- ]?work)\b", r"(transaction|transactional|\bcommit\b|rollback|unitofwork)",
        r"^(Transactional|TransactionAttribute|EnableTransactionManagement)$", ("spring:transactional", "spring:enable-tx", "jakarta:transaction-attribute", "jakarta:tx-management"), ("transaction", "rollback", "unitofwork"),
    ),
    Concept(
        "cache", r"\b(cache|caches|caching|cached|evict|eviction|memoize|memoized|memoization)\b", r"(cache|caching|evict|memoiz)", r"^(Cacheable|CacheEvict|CachePut|Caching|EnableCaching)$",
        ("spring:cacheable", "spring:cache-evict", "spring:enable-caching"), ("cache", "caching", "evict", "memoiz"),
    ),
    Concept(
        "scheduling", r"\b(schedule|scheduled|scheduler|scheduling|cron|periodic|periodically|background[- ]?job|background[- ]?task|async|asynchronous|asynchronously)\b", r"(schedul|\bcron\b|\basync\b|background(job|task)|worker|periodic)",
        r"^(Scheduled|Async|EnableScheduling|EnableAsync|Schedule|Asynchronous)$", ("spring:scheduled", "spring:enable-scheduling", "spring:async", "spring:enable-async", "jakarta:schedule", "jakarta:ejb-async"), ("schedul", "async", "periodic"),
    ),
    Concept(
        "validation", r"\b(validation|validate|validated|validates|validator|validating|constraint|constraints|invalid|malformed)\b", r"(validat|validator|constraint)",
        r"^(Valid|Validated|NotNull|NotBlank|NotEmpty|Size|Pattern|Min|Max|Email|Positive|Negative|Constraint|AssertTrue|AssertFalse|Past|Future|Digits)$", (), ("validat", "constraint"),
    ),
    Concept(
        "messaging", r"\b(event|events|listener|listeners|publish|published|publisher|subscribe|subscriber|subscription|message|messages|messaging|queue|kafka|rabbit|rabbitmq|jms|amqp|pub[- ]?sub|broker)\b",
        r"(event|listener|publish|subscrib|\bmessage\b|messaging|consumer|producer|\bqueue\b|kafka|rabbit)", r"^(EventListener|TransactionalEventListener|Observes|ObservesAsync|MessageDriven|KafkaListener|RabbitListener|JmsListener|StreamListener)$",
        ("spring:event-listener", "jakarta:observes", "jakarta:message-driven"), ("listener", "publish", "subscrib", "messaging", "kafka", "rabbit"),
    ),
)


@dataclass(frozen=True)
class Query:
    """What a query asks for."""

    text: str
    tokens: tuple[str, ...]
    concepts: tuple[Concept, ...] = ()
    entry_point: bool = False
    compact: str = field(default="")

    @property
    def lower(self) -> str:
        return self.text.lower()


def asked(text: str, stop: tuple[str, ...] = T.STOP_WORDS) -> Query:
    """A query's tokens, concepts and intent; ``*`` asks for everything."""
    entry = re.search(r"\bentry\s*point\b|\bmain\s+application\b|\bapplication\s+entry\b", text.lower()) is not None
    concepts = tuple(c for c in CONCEPTS if re.search(c.trigger, text, re.IGNORECASE))
    return Query(text, tuple(T.query_tokens(text, stop)), concepts, entry, re.sub("[^a-z0-9]+", "", text.lower()))


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _count(conditions) -> Column:
    return reduce(lambda a, b: a + b, [c.cast("int") for c in conditions], F.lit(0))


def _pick(c: str, points: dict) -> Column:
    out = F.lit(0)
    for value, n in points.items():
        out = F.when(F.col(c) == value, n).otherwise(out)
    return out


def _stemmed(words: Column) -> Column:
    """Words with their stems."""
    return F.transform(words, lambda w: F.struct(w.alias("w"), T.stem(w).alias("s")))


def _has_stemmed(words: Column, token: str) -> Column:
    return F.exists(words, lambda x: T.shares_stem(x["w"], token, x["s"]))


def _marked(annotations: Column, c: Concept) -> Column:
    return F.coalesce(F.exists(annotations, lambda a: a.rlike("(?i)" + c.annotations)), F.lit(False))


def _lower(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))


def concept_points(name: Column, role: Column, annotations: Column, c: Concept) -> Column:
    """Points of one concept: the best of its name, annotation and role marks."""
    return F.when(name.rlike(c.names), BY_NAME).when(_marked(annotations, c), BY_ANNOTATION).when(role.isin(*c.roles) if c.roles else F.lit(False), BY_ROLE).otherwise(0)


def concept_score(q: Query, name: str = "name", role: str = "framework_role", annotations: str = "annotations") -> Column:
    """Points of all concepts of the query, ``CONCEPT_CAP`` at most."""
    return F.least(reduce(lambda a, b: a + b, [concept_points(_lower(name), _lower(role), F.col(annotations), c) for c in q.concepts], F.lit(0)), F.lit(CONCEPT_CAP))


def concept_candidates(rows: DataFrame, q: Query) -> DataFrame:
    """Rows that a concept's terms, annotations or roles point at."""
    terms = [contains_text("name", t) for c in q.concepts for t in c.like]
    marks = [_marked(F.col("annotations"), c) for c in q.concepts]
    roles = [r for c in q.concepts for r in c.roles]
    return rows.filter(_any(F.coalesce(x, F.lit(False)) for x in [*terms, *marks, *([_lower("framework_role").isin(*roles)] if roles else [])]))


def intent_score(q: Query) -> Column:
    """Entry points: main methods 125, application annotations 86, command line runners 74, application classes 42."""
    if not q.entry_point:
        return F.lit(0)
    name = _lower("name")
    return (
        F.when((F.col("kind") == "method") & (name == "main"), 125).otherwise(0)
        + F.when(F.array_contains("annotations", "SpringBootApplication") | (F.col("framework_role") == "spring:application"), 86).otherwise(0)
        + F.when(_lower("signature").contains("commandlinerunner") | _lower("fq_name").contains("commandlinerunner"), 74).otherwise(0)
        + F.when(F.col("kind").isin("class", "interface") & name.endswith("application"), 42).otherwise(0)
    )


def kind_points(c: str = "kind") -> Column:
    return _pick(c, {k: n for n, kinds in KIND.items() for k in kinds})


def ranked_symbols(rows: DataFrame, q: Query) -> DataFrame:
    """Rows with a match of any kind, with ``score`` and ``n_matched``.

    ``rows``: fq_name, name, kind, file, package, role, framework_role, signature, annotations (array), db_name, synthetic,
    in_degree; null text counts as empty.
    """
    name, fq, db = _lower("name"), _lower("fq_name"), _lower("db_name")
    small_name, small_fq, small_db = T.compact(name), T.compact(fq), T.compact(db)
    text = F.concat_ws(" ", name, fq, *(_lower(c) for c in ("file", "package", "framework_role", "signature")), F.lower(F.array_join("annotations", " ")), db)
    small = F.concat_ws(" ", small_name, small_fq, T.compact(_lower("file")), small_db)
    rows = rows.select("*", text.alias("_text"), small.alias("_small"), name.alias("_name"), small_name.alias("_cname"))
    n = len(q.tokens)
    hits = _count(F.col("_text").contains(t) | F.col("_small").contains(t) for t in q.tokens)
    named = _count(F.col("_name").contains(t) | F.col("_cname").contains(t) for t in q.tokens)
    rows = rows.select("*", hits.alias("n_matched"), named.alias("_named"), intent_score(q).alias("_intent"), concept_score(q).alias("_concept"))
    phrase = (name == q.lower) | (fq == q.lower) | name.contains(q.lower) | fq.contains(q.lower)
    member = (fq == q.lower) | fq.endswith("." + q.lower) if "." in q.lower else F.lit(False)
    told = (F.length(db) >= 5) & db.contains("_") & F.expr("locate(concat(' ', db_name, ' '), _spaced) > 0")
    rows = rows.withColumn("_spaced", F.lit(" " + re.sub("[^a-z0-9_]", " ", q.lower) + " "))
    physical = (db != "") & ((db == q.lower) | (small_db == q.compact if q.compact else F.lit(False)) | told)
    every = F.col("n_matched") == n
    tier = (
        F.when(physical & (name != q.lower), 122).when(member & (name != q.lower), 135).when((name == q.lower) | (fq == q.lower), 120)
        .when((small_name == q.compact) | small_fq.endswith(q.compact) if q.compact else F.lit(False), 112).when(phrase, 98).when(every & (F.col("_named") == n), 88).when(every, 74)
        .when(F.col("n_matched") > 0, 40 + T.half_up(F.col("n_matched") / max(n, 1) * 30) + F.when(F.col("_named") > 0, 8).otherwise(0)).otherwise(0)
    )
    lone = _only(q, "point") if q.entry_point else F.lit(False)
    kind = kind_points()
    score = (
        tier + F.when(F.col("_intent") > 0, F.col("_intent")).when(lone, -35).otherwise(0) + F.when(F.col("synthetic"), -60).otherwise(0)
        + F.when((F.col("_named") > 0) | phrase, kind).otherwise(0) + _pick("role", SYMBOL_ROLE)
        + F.least(T.half_up(F.log1p(F.coalesce("in_degree", F.lit(0))) * 6), F.lit(15))
        + F.col("_concept") + F.when((F.col("_concept") > 0) & (F.col("n_matched") == 0) & ~phrase, kind).otherwise(0)
    )
    found = rows.withColumn("score", score.cast("bigint")).filter((F.col("n_matched") > 0) | phrase | (F.col("_intent") > 0) | (F.col("_concept") > 0))
    return found.drop("_text", "_small", "_name", "_cname", "_named", "_intent", "_concept", "_spaced")


def _only(q: Query, token: str) -> Column:
    """The token is the only one that matches."""
    if token not in q.tokens:
        return F.lit(False)
    return (F.col("n_matched") == 1) & (F.col("_text").contains(token) | F.col("_small").contains(token))


def symbol_order() -> list[Column]:
    """Score, then role, then name; full name and file make the order total."""
    return [F.desc("score"), F.desc(_pick("role", ROLE_RANK)), F.col("name"), F.col("fq_name"), F.col("file")]


def listed(rows: DataFrame, name: str, offset: int, limit: int) -> DataFrame:
    """List mode (``*``): by role, then name."""
    order = ("main_source", "resource_config", "build_config", "test_source", "mock_source", "generated")
    rank = F.lit(len(order))
    for k, r in enumerate(order):
        rank = F.when(F.col("role") == r, k).otherwise(rank)
    return page(rows, [rank, F.col(name), *(F.col(c) for c in rows.columns if c in ("fq_name", "file", "path") and c != name)], offset, limit)


def search_symbols(rows: DataFrame, text: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of symbols by rank."""
    q = asked(text)
    return page(ranked_symbols(rows, q), symbol_order(), offset, limit) if q.tokens else listed(rows, "name", offset, limit)


def search_summary(rows: DataFrame, text: str) -> DataFrame:
    """dim, value, n: facets of all matches, their number (``total``) and the answer's confidence in hundredths."""
    found = ranked_symbols(rows, asked(text)).withColumn("framework_role", F.coalesce("framework_role", F.lit("none")))
    total = found.agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("s"))
    sure = F.when(F.col("s") >= 90, 85).otherwise(65).cast("bigint")
    rest = total.select(F.explode(F.array(F.struct(F.lit("total").alias("dim"), F.lit("all").alias("value"), "n"), F.struct(F.lit("confidence").alias("dim"), F.lit("all").alias("value"), sure.alias("n")))).alias("x"))
    return facets(found, ["role", "kind", "framework_role", "synthetic"]).union(rest.select("x.*"))


def ranked_files(files: DataFrame, symbols: DataFrame, endpoints: DataFrame, q: Query) -> DataFrame:
    """Files (path, language, role, degree, bm25) with ``score`` and ``n_matched``.

    Evidence is what a file's symbols (file, name, fq_name, kind, signature, framework_role, annotations) and endpoints
    (file, method, path) say, in one aggregate each.  What the score asks for several times is a column of its own, so that its expression
    stands in the plan once.
    """
    path = F.col("_path")
    base = F.regexp_replace(T.base_name(F.col("path")), r"\.[^.]+$", "")
    text = F.lower(F.concat_ws(" ", "name", "fq_name", "kind", "signature", "framework_role", F.array_join("annotations", " ")))
    covers = [F.col(f"_w{k}") for k in range(len(q.tokens))]
    phrase = (_count(covers) >= 2) & _any(c for c, t in zip(covers, q.tokens) if not T.is_broad(t))
    role, name = F.col("_role"), F.col("name")
    like = {
        "service": role.contains("service") | name.endswith("Service"), "repository": role.contains("repository") | name.endswith("Repository") | name.endswith("Dao"),
        "entity": role.contains("entity") | name.endswith("Entity"), "mybatis": role.startswith("mybatis:"), "docker": role.startswith("docker:"),
        "spec": role.isin("openapi:endpoint", "postman:request") | role.startswith("elastic-rest:"),
    }
    s = symbols.select("*", text.alias("_t"), _lower("name").alias("_name"), _lower("framework_role").alias("_role"), _stemmed(T.word_parts(name)).alias("_words"))
    s = s.select("*", *(_has_stemmed(F.col("_words"), t).alias(f"_w{k}") for k, t in enumerate(q.tokens))).groupBy(F.col("file").alias("path")).agg(
        F.max(phrase).alias("_phrase"), *(F.max(F.col("_t").contains(t)).alias(f"_s{k}") for k, t in enumerate(q.tokens)), *(F.max(v).alias(f"_{k}") for k, v in like.items()),
        *(F.max(concept_points(F.col("_name"), role, F.col("annotations"), c) > 0).alias(f"_c{k}") for k, c in enumerate(q.concepts)),
    )
    told = F.lower(F.concat_ws(" ", "method", "path"))
    e = endpoints.select("file", told.alias("_t")).groupBy(F.col("file").alias("path")).agg(F.lit(True).alias("_e"), F.max(F.col("_t").contains(q.lower)).alias("_ep"), *(F.max(F.col("_t").contains(t)).alias(f"_e{k}") for k, t in enumerate(q.tokens)))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = len(q.tokens)
    other = F.lower(F.concat_ws(" ", "language", "role"))
    asked_of = files.select("*", F.lower("path").alias("_path"), F.lower(T.base_name(F.col("path"))).alias("_name"), F.lower(base).alias("_base"), T.stem(F.lower(base)).alias("_stem"), _stemmed(T.word_parts(base)).alias("_words"), T.compact(F.lower("path")).alias("_small"), other.alias("_other"))
    whole = _any(T.shares_stem(F.col("_base"), t, F.col("_stem")) for t in q.tokens if not T.is_broad(t))
    asked_of = asked_of.select("*", whole.alias("_whole"), *(_has_stemmed(F.col("_words"), t).alias(f"_p{k}") for k, t in enumerate(q.tokens)), *(path.contains(t).alias(f"_in{k}") for k, t in enumerate(q.tokens)))
    in_path, parts = ([F.col(f"{c}{k}") for k in range(n)] for c in ("_in", "_p"))
    special = [c for c, t in zip(parts, q.tokens) if not T.is_broad(t)]
    said = lambda pattern: re.search(pattern, q.text, re.IGNORECASE) is not None
    wants = [  # fixed values: what a query's words ask a file for, and the points that it gives
        (said(r"\bendpoint|route|controller\b"), "_e", 40), (said(r"\bservice\b"), "_service", 32), (said(r"\brepository|repo|dao\b"), "_repository", 32), (said(r"\bentity|model\b"), "_entity", 32),
        (said(r"\b(mybatis|mapper|sql|result\s*map|resultmap|mapper\s+xml|xml\s+mapper)\b"), "_mybatis", 60), (said(r"\b(openapi|swagger|postman|api\s+doc|api\s+spec|rest\s+api|yaml\s+rest|endpoint)\b"), "_spec", 55),
        (said(r"\b(docker|compose|container|port|service)\b"), "_docker", 45),
    ]
    score = (
        F.when((path == q.lower) | (F.col("_name") == q.lower), 120).when(path.contains(q.lower), 90).otherwise(0)
        + (F.when(_count(in_path) == n, 70).otherwise(18 * _count(in_path)) if n else F.lit(0)) + F.when(F.col("_whole"), 90).otherwise(0) + 45 * _count(special)
        + F.when((_count(parts) >= 2) & _any(special), 110).otherwise(0) + F.when(yes("_phrase"), 80).otherwise(0) + 70 * _count(path.contains(i) for i in T.identifier_terms(q.lower))
        + 20 * _count(yes(f"_s{k}") for k in range(n)) + F.when(yes("_ep"), 55).otherwise(24 * _count(yes(f"_e{k}") for k in range(n)))
        + sum((F.when(yes(c), points).otherwise(0) for on, c, points in wants if on), F.lit(0))
        + F.least(F.coalesce("degree", F.lit(0)), F.lit(10)) + F.coalesce("bm25", F.lit(0)) + T.half_up(_pick("role", ROLE_RANK) / 10)
        + F.least(BY_FILE * _count(yes(f"_c{k}") for k in range(len(q.concepts))), F.lit(CONCEPT_CAP))
    )
    hits = _count(F.col(f"_in{k}") | F.col("_small").contains(t) | F.col("_other").contains(t) | yes(f"_s{k}") | yes(f"_e{k}") for k, t in enumerate(q.tokens))
    out = asked_of.join(s, "path", "left").join(e, "path", "left").select(*files.columns, score.cast("bigint").alias("score"), hits.alias("n_matched"), _any(yes(f"_c{k}") for k in range(len(q.concepts))).alias("_c"))
    return out.filter((F.col("n_matched") > 0) | F.col("_c") | (F.col("score") > _pick("role", ROLE_RANK) / 10)).drop("_c")


def file_order() -> list[Column]:
    return [F.desc("score"), F.desc(_pick("role", ROLE_RANK)), F.col("path")]


def search_files(files: DataFrame, symbols: DataFrame, endpoints: DataFrame, text: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of files by rank; a file that the query names outright stands alone, unless the query asks how or why."""
    q = asked(text, T.FILE_STOP_WORDS)
    if not q.tokens:
        return listed(files, "path", offset, limit)
    explicit = re.findall(r"[\w./-]+\.(?:java|ts|tsx|js|jsx|py|xml|ya?ml|json|properties)\b", text)
    if explicit and not re.search(r"\b(how|does|what|why|trace|explain|understand|describe|walk|analyze|overview)\b", text, re.IGNORECASE):
        named = files.filter(_any((F.lower("path") == x.lower()) | F.lower("path").endswith("/" + x.lower()) for x in explicit))
        if not named.isEmpty():
            files = named
    return page(ranked_files(files, symbols, endpoints, q), file_order(), offset, limit)


def mixed(sections: dict[str, DataFrame]) -> DataFrame:
    """section, place, key, score: ranked sections (key, score) below each other, each by its own order."""
    from pyspark.sql import Window as W

    every = None
    for name, df in sections.items():
        part = df.select(F.lit(name).alias("section"), F.row_number().over(W.partitionBy(F.lit(name)).orderBy(F.desc("score"), "key")).alias("place"), "key", F.col("score").cast("double").alias("score"))
        every = part if every is None else every.union(part)
    return every


#: How a call was resolved where that speaks for it, and owners that speak for or against it.
SURE = ("receiver-field", "receiver-field-chain", "receiver-type-field", "receiver-type-chain", "interface-implementation", "enclosing-method", "super-method", "static-import", "receiver-type")
OWNERS = r"\b(Service|Client|Manager|Context|Store|Repository|Dao|Request|Response|Builder|Info|Entity|Controller)\b"
LIBRARY = r"\b(Logger|String|HashSet|ArrayList|List|Set|Map|ConcurrentMap|AtomicLong|Objects|Optional)\."
MADE = r"\b(Request|Response|Info|Entity|Builder|Service|Client)\.new$"


def call_edge_score() -> Column:
    """How much an edge (callee, confidence, tier, resolution) tells about a flow."""
    callee = F.col("callee")
    return (
        F.col("confidence") * 100 + F.when(F.col("tier") == "provider", 30).when(F.col("tier") == "primary", 20).otherwise(5) + F.when(F.col("resolution").isin(*SURE), 8).otherwise(0)
        + F.when(callee.rlike(OWNERS), 18).otherwise(0) - F.when(callee.rlike(LIBRARY), 24).otherwise(0) - F.when(callee.rlike(r"\.new$") & ~callee.rlike(MADE), 8).otherwise(0)
    )


def definition_score(callee: Column, edge_file: Column) -> Column:
    """How well a symbol (fq_name, name, kind, file, role) fits as the definition of a callee of a file."""
    ext = lambda c: F.lower(F.regexp_extract(c, r"\.[^./]+$", 0))
    fixture = lambda c: F.regexp_extract(c, r"(?:^|/)tests/fixtures/([^/]+)/", 1)
    called, name, own = F.lower(F.regexp_replace(callee, r"\([^)]*\)$", "")), F.lower("name"), F.col("file")
    a, b = (F.filter(F.split(x, "/"), lambda p: p != "") for x in (own, edge_file))
    differs = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: ~x["a"].eqNullSafe(x["b"]))
    shared = F.when(F.array_position(differs, True) > 0, F.array_position(differs, True) - 1).otherwise(F.size(a))
    owner = F.regexp_replace(called, r"\.new$", "")
    made = called.endswith(".new") & ((owner == name) | F.endswith(owner, F.concat(F.lit("."), name)))
    return (
        F.when(ext(own) == ext(edge_file), 80).otherwise(0) + shared * 8 + F.when((fixture(own) != "") & (fixture(own) == fixture(edge_file)), 60).otherwise(0)
        + F.when(F.col("role") == "main_source", 20).when(F.col("role") == "test_source", -20).otherwise(0) + F.when(F.col("kind").isin("method", "function"), 20).otherwise(0)
        + F.when(F.contains(F.lower("fq_name"), called), 35).otherwise(0) + F.when((called == name) | F.endswith(called, F.concat(F.lit("."), name)), 15).otherwise(0)
        + F.when(made, F.when(F.col("kind").isin("class", "record", "interface", "enum"), 50).otherwise(30)).otherwise(0) + F.when(own == edge_file, 5).otherwise(0)
    )


def definition_candidates(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """callee, edge_file, line, fq_name, file, name, kind, role: for each distinct edge, the symbols of the callee's last name that can fit it best.

    A score is made of what the symbol alone brings (role, kind) and of what it shares with the edge, which only adds to it: leading folders, the
    extension, the fixture, the file, and whether its qualified name holds the callee.  Of symbols that are alike in all of these the first by line,
    qualified name and file stands for the others, so an edge meets as many rows as there are such kinds, however many symbols have the name.
    """
    bare = lambda c: F.regexp_replace(c, r"\([^)]*\)$", "")
    last = lambda c: F.lower(F.substring_index(F.regexp_replace(bare(c), r"\.new$", ""), ".", -1))
    folders = "filter(split(coalesce({0}, ''), '/'), p -> p <> '')"
    # '' and each leading run of folders, and the file itself (after a slash, so that it is no run)
    places = lambda c: F.expr(f"array_compact(array_append(transform(sequence(0, size({folders.format(c)})), n -> array_join(slice({folders.format(c)}, 1, n), '/')), concat('/', {c})))")
    e = edges.select("callee", F.col("file").alias("edge_file")).distinct().withColumns({"_last": last(F.col("callee")), "_called": F.lower(bare(F.col("callee")))})
    s = symbols.select(F.lower("name").alias("_last"), F.lower("fq_name").alias("_fq"), "line", "fq_name", "file", "name", "kind", "role")
    role = F.when(F.col("role").isin("main_source", "test_source"), F.col("role")).alias("_role")
    kind = F.when(F.col("kind").isin("method", "function"), 1).when(F.col("kind").isin("class", "record", "interface", "enum"), 2).otherwise(0).alias("_kind")
    fixture = F.regexp_extract("file", r"(?:^|/)tests/fixtures/([^/]+)/", 1).alias("_fixture")
    alike = [role, kind, F.lower(F.regexp_extract("file", r"\.[^./]+$", 0)).alias("_ext"), fixture]
    first = F.min(F.struct("line", "fq_name", "file", "name", "kind", "role")).alias("s")
    near = s.groupBy("_last", "_fq", "file", *alike).agg(first).withColumn("_place", F.explode(places("file")))
    group = ["_last", "_place", "_role", "_kind", "_ext", "_fixture"]
    # parts of a qualified name that end in the name (or in its constructor): a callee that it holds is one of them
    ends = "flatten(transform(filter(sequence(1, length(_fq) - length(_last) + 1), p -> substring(_fq, p, length(_last)) = _last), p -> array(p + length(_last), if(substring(_fq, p + length(_last), 4) = '.new', p + length(_last) + 4, null))))"
    parts = F.expr(f"array_distinct(flatten(transform(array_compact({ends}), q -> transform(sequence(1, q), i -> substring(_fq, i, q - i)))))")
    names = s.select("_last", "_fq").distinct().filter("length(_fq) >= length(_last)")
    held = names.select("_last", "_fq", F.explode(parts).alias("_called")).join(e.select("_last", "_called").distinct(), ["_last", "_called"])
    least = F.min("s").alias("s")
    reps = near.groupBy(*group).agg(least)
    holding = near.join(held, ["_last", "_fq"]).groupBy("_called", *group).agg(least)
    at = e.withColumn("_place", F.explode(places("edge_file")))
    met = at.join(reps, ["_last", "_place"]).select("callee", "edge_file", "s.*").union(at.join(holding, ["_last", "_called", "_place"]).select("callee", "edge_file", "s.*"))
    return met


def best_definitions(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """callee, edge_file, fq_name, file, score: the symbol that fits each distinct edge best, among those of the callee's last name."""
    found = definition_candidates(edges, symbols).withColumn("score", definition_score(F.col("callee"), F.col("edge_file")).cast("bigint"))
    best = F.min(F.struct((-F.col("score")).alias("s"), "line", "fq_name", "file")).alias("b")
    return found.groupBy("callee", "edge_file").agg(best).select("callee", "edge_file", "b.fq_name", "b.file", (-F.col("b.s")).alias("score"))
