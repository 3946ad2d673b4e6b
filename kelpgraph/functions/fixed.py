"""Word lists and limits that results depend on, as the data model defines them."""

#: Directory names that a source scan skips.
EXCLUDED_DIRS = (".git", "target", "build", "node_modules", "__pycache__", ".idea", ".vscode")

#: Layer names with their priority; a path that names several gets the first of these.
LAYER_PRIORITY = {
    "action": 1, "controller": 1, "facade": 2, "service": 3, "biz": 4, "bl": 5, "dal": 6, "dao": 7, "model": 8,
    "entity": 9, "vo": 10, "dto": 11, "util": 12, "utils": 13, "helper": 14, "common": 15,
}
OTHER_PRIORITY = 99

#: Path segments that never name a domain.
DOMAIN_SKIP = (
    "", ".", "..", "fixtures", "src", "main", "java", "resources", "simple", "ssh", "reins", "target", "build", "test", "tests",
    "controller", "action", "service", "facade", "biz", "bl", "dal", "dao", "model", "entity", "vo", "dto", "util", "utils", "helper", "common", "utility",
)

#: Coarse buckets: path segments first, then class name endings and beginnings.
BUCKET_PATHS = {
    "ui": ("controller", "action", "interf", "interface", "api", "web", "ui"),
    "db": ("dal", "dao", "repository", "db", "mapper"),
    "bl": ("service", "biz", "bl", "facade"),
}
BUCKET_ENDS = {"ui": ("action", "controller", "interf", "api"), "db": ("dao", "repository", "mapper"), "bl": ("service", "biz", "facade")}
BUCKET_BEGINS = {"ui": (), "db": ("db",), "bl": ("bl",)}
#: A caller's bucket may not call this bucket.
FORBIDDEN = (("ui", "db"), ("db", "bl"), ("bl", "ui"))

#: Method names that very likely belong to the JDK.
JDK_METHODS = (
    "abs", "add", "before", "compareTo", "contains", "currentTimeMillis", "divide", "endsWith", "equals", "filter", "findFirst", "format",
    "getMessage", "getStackTrace", "getTime", "isEmpty", "iterator", "length", "multiply", "nanoTime", "now", "orElse", "randomUUID", "remove",
    "setScale", "size", "split", "startsWith", "stream", "substring", "subtract", "toString", "trim", "valueOf",
)

UNKNOWN_CATEGORIES = ("jdk_core", "infra_framework", "third_party_lib", "internal_shared_lib_missing", "true_unresolved")
INFRA_MARKERS = ("logger", "log", "transaction", "tx", "sqlsession", "mapper", "jdbc", "hibernate", "mybatis", "spring", "cache", "redis", "mq", "kafka", "resttemplate", "entitymanager")
THIRD_PARTY_MARKERS = ("fastjson", "jackson", "gson", "guava", "hutool", "apache", "commons", "okhttp", "poi", "lombok")
SHARED_MARKERS = ("dto", "vo", "dao", "service", "facade", "action", "util", "helper", "manager", "client")
SHARED_CLASS_MARKERS = ("common", "shared", "base")

#: Class role bonus of the greedy chain walk; the first row with a marker in the class name counts.
ROLE_BONUS = ((("controller", "action", "interf"), 1), (("facade",), 3), (("service", "biz", "bl"), 4), (("dal", "dao", "repository"), 5), (("util", "helper", "common"), -2))

MAPPER_ANNOTATIONS = ("Mapper", "MapperScan")
SERVICE_ANNOTATIONS = ("Service", "Component", "Repository", "Controller", "RestController", "Configuration")
BEAN_ANNOTATIONS = (*SERVICE_ANNOTATIONS, "Bean")
INJECTION_ANNOTATIONS = ("Autowired", "Resource", "Inject")
MAPPER_CONFIDENCE = 0.80

DEPTH, HARD_DEPTH = 10, 20
RESULTS, FAN_OUT, TREE_NODES = 1000, 100, 1000
ENTRY_POOL, ENTRY_SCORE, ENTRY_LIMIT = 1000, 8, 200

#: Threshold gate: (metric, comparison, bound, mandatory). The hop hit rate is the retention by another name.
GATE = (
    ("broken_chain_rate", "<=", 0.35, True), ("business_broken_chain_rate", "<=", 0.02, True), ("reachability_rate", ">=", 0.75, True),
    ("key_chain_hit_rate", ">=", 1.0, True), ("key_chain_hop_hit_rate", ">=", 1.0, True), ("critical_chain_retention", ">=", 1.0, True), ("critical_hop_dropout", "<=", 0.1, True),
    ("util_unknown_ratio", "<=", 0.85, True), ("critical_chain_coverage", ">=", 0.0, True), ("critical_definition_presence", ">=", 0.0, True),
)

#: What the report's metrics say: (metric, better if, shown as, meaning).
CATALOGUE = (
    ("broken_chain_rate", "lower", "percent", "edges to methods that no source defines, of all edges"),
    ("business_broken_chain_rate", "lower", "percent", "the same without calls into the JDK"),
    ("reachability_rate", "higher", "percent", "methods that an entry reaches, entries included, of all methods"),
    ("key_chain_hit_rate", "higher", "percent", "critical chains whose hops are all edges"),
    ("critical_chain_retention", "higher", "percent", "hops of critical chains that are edges"),
    ("critical_hop_dropout", "lower", "percent", "hops of critical chains that are no edges"),
    ("util_unknown_ratio", "lower", "percent", "unknown edges that start in utility classes"),
    ("critical_chain_coverage", "higher", "percent", "methods of critical chains that an entry reaches"),
    ("critical_chain_reach_share", "neutral", "percent", "methods of critical chains, of all that an entry reaches"),
    ("critical_definition_presence", "higher", "percent", "methods of critical chains that a source defines"),
    ("entry_confidence_proxy", "higher", "percent", "entries scored with high confidence"),
    ("layer_violation_rate", "lower", "percent", "edges between layers that may not call one another"),
    ("cycle_count", "lower", "count", "pairs of classes that call one another"),
    ("god_method_ratio", "lower", "percent", "methods with more than a hundred edges out"),
    ("isolated_method_ratio", "lower", "percent", "methods without any edge"),
    ("hotspot_fragility_top20_share", "lower", "percent", "calls that the twenty most called methods receive"),
)
