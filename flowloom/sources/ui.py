"""UI, command-line, RPC and object-storage extractors: processes, screens, navigation, remote objects. Table-driven like ``extract``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.sources.extract import _Q, _hits, normal_route

#: (framework, language, pattern, kind, group of the name, group of the function that it runs or 0)
PROCESSES: list[tuple[str, str, str, str, int, int]] = [
    ("react", "ts", r"\b(on[A-Z]\w+)=\{\s*(?:\(\w*\)\s*=>\s*)?(\w+)", "event_handler", 1, 2),
    ("react", "ts", r"\b(useEffect|useLayoutEffect)\(\s*(?:\(\)\s*=>\s*\{?\s*)?(\w+)", "lifecycle_hook", 1, 2),
    ("dom", "ts", r"\.addEventListener\(\s*[\"'](\w+)[\"']\s*,\s*(\w+)", "event_handler", 1, 2),
    ("vue", "ts", r"\b(onMounted|onUnmounted|onBeforeMount|watch|watchEffect)\(\s*(?:\(\)\s*=>\s*)?(\w+)", "lifecycle_hook", 1, 2),
    ("angular", "ts", r"\b(ngOnInit|ngOnDestroy|ngAfterViewInit|ngOnChanges)\(\s*\)", "lifecycle_hook", 1, 1),
    ("react-query", "ts", r"\b(useQuery|useMutation|useInfiniteQuery)\(\s*\{[^}]*?(?:queryFn|mutationFn):\s*(?:\(\)\s*=>\s*)?(\w+)", "query_hook", 1, 2),
    ("swr", "ts", r"\b(useSWR|useSWRMutation)\([^,)]+,\s*(\w+)", "query_hook", 1, 2),
    ("state-mgmt", "ts", r"\btake(?:Every|Latest|Leading)\(\s*[\"']?([\w/.]+)[\"']?\s*,\s*(\w+)", "saga_watcher", 1, 2),
    ("pycli", "py", r"@(?:\w+\.)?command\([^)]*\)\s*(?:@[^\n]*\s*)*def\s+((\w+))", "cli_command", 1, 2),
    ("pycli", "py", r"if\s+(__name__)\s*==\s*[\"']__main__[\"']", "script_entry", 1, 0),
    ("gocli", "go", r"cobra\.Command\{\s*Use:\s*\"(\w+)", "cli_command", 1, 0),
    ("rustcli", "rust", r"#\[tauri::command\]\s*(?:pub\s+)?(?:async\s+)?fn\s+((\w+))", "bridge_command", 1, 2),
    ("tokio-spawn", "rust", r"tokio::(spawn)\(\s*(?:async\s+move\s*\{\s*)?(\w+)", "background_task", 1, 2),
]
#: (framework, language, pattern, navigator, group of the route, group of the component)
SCREENS: list[tuple[str, str, str, str, int, int]] = [
    ("react-router", "ts", rf"<Route\b[^>]*?path={_Q}[^>]*?(?:element=\{{<|component=\{{)(\w+)", "router", 1, 2),
    ("react-router", "ts", rf"\{{\s*path:\s*{_Q}\s*,\s*element:\s*<(\w+)", "router", 1, 2),
    ("react-native", "ts", rf"<\w+\.Screen\b[^>]*?name={_Q}[^>]*?component=\{{(\w+)", "stack", 1, 2),
    ("vue", "ts", rf"\{{\s*path:\s*{_Q}\s*,(?:\s*name:[^,]*,)?\s*component:\s*(\w+)", "router", 1, 2),
]
#: (framework, language, pattern, group of the target, method)
NAVIGATIONS: list[tuple[str, str, str, int, str]] = [
    ("react-router", "ts", rf"<(?:Link|NavLink)\b[^>]*?to={_Q}", 1, "link"),
    ("react-router", "ts", rf"\bnavigate\(\s*{_Q}", 1, "navigate"),
    ("react-native", "ts", rf"\bnavigation\.(?:navigate|push|replace)\(\s*{_Q}", 1, "navigate"),
    ("nextjs", "ts", rf"\brouter\.(?:push|replace)\(\s*{_Q}", 1, "push"),
]
#: (framework, language, pattern, scheme, group of the bucket, group of the key or 0)
OBJECTS: list[tuple[str, str, str, str, int, int]] = [
    ("aws-s3-ts", "ts", rf"new\s+(?:Get|Put|Delete|Head)ObjectCommand\(\s*\{{\s*Bucket:\s*{_Q}\s*,\s*Key:\s*{_Q}", "s3", 1, 2),
    ("boto3", "py", rf"\.(?:get|put|delete|head)_object\(\s*Bucket={_Q}\s*,\s*Key={_Q}", "s3", 1, 2),
    ("gcs-ts", "ts", rf"\.bucket\({_Q}\)\.file\({_Q}\)", "gs", 1, 2),
    ("gcs-py", "py", rf"\.bucket\({_Q}\)\.blob\({_Q}\)", "gs", 1, 2),
    ("gcs-go", "go", rf"\.Bucket\({_Q}\)\.Object\({_Q}\)", "gs", 1, 2),
    ("azure-blob-ts", "ts", rf"\.getContainerClient\({_Q}\)\.get\w*BlobClient\({_Q}\)", "azure", 1, 2),
    ("azure-blob-py", "py", rf"\.get_blob_client\((?:container=)?{_Q}\s*,\s*(?:blob=)?{_Q}", "azure", 1, 2),
]
#: Servers of remote procedures: (framework, language, pattern, group of the service, group of the method)
RPC: list[tuple[str, str, str, int, int]] = [
    ("grpcgo", "go", r"func\s+\(\w+\s+\*?(\w+)Server\)\s+([A-Z]\w+)\(\s*ctx", 1, 2),
    ("trpc", "ts", r"(\w+):\s*(?:public|protected)?[pP]rocedure[\s\S]{0,200}?\.(query|mutation)\(", 1, 2),
]


def _base(h: DataFrame, framework: str, *cols) -> DataFrame:
    return h.select("repository", "path", "line", F.lit(framework).alias("framework"), *cols)


def processes(files: DataFrame) -> DataFrame:
    """(repository, path, line, framework, kind, name, function)."""
    out = []
    for framework, language, pattern, kind, name, function in PROCESSES:
        fn = F.regexp_extract("hit", pattern, function) if function else F.lit(None).cast("string")
        out.append(_base(_hits(files, language, pattern), framework, F.lit(kind).alias("kind"), F.regexp_extract("hit", pattern, name).alias("name"), fn.alias("function")))
    return reduce(DataFrame.unionByName, out)


def screens(files: DataFrame) -> DataFrame:
    """(repository, path, line, framework, navigator, route, component), routes by file convention included."""
    out = []
    for framework, language, pattern, navigator, route, component in SCREENS:
        out.append(_base(_hits(files, language, pattern), framework, F.lit(navigator).alias("navigator"), F.regexp_extract("hit", pattern, route).alias("route"), F.regexp_extract("hit", pattern, component).alias("component")))
    pages = files.where(F.col("path").rlike(r"(?:^|/)(?:pages|app)/.*\.(?:tsx|jsx)$") & ~F.col("path").rlike(r"/(?:api|_app|_document|layout|loading|error)[./]"))
    out.append(pages.select("repository", "path", F.lit(1).alias("line"), F.lit("nextjs").alias("framework"), F.lit("file").alias("navigator"), page_route(F.col("path")).alias("route"), F.regexp_extract("content", r"export\s+default\s+(?:async\s+)?function\s+(\w+)", 1).alias("component")))
    return reduce(DataFrame.unionByName, out)


def page_route(path):
    """The route of a page file: ``[id]`` is a parameter, ``[...rest]`` takes the rest, groups in brackets don't show."""
    x = F.regexp_replace(path, r"^(?:.*/)?(?:pages|app)/", "")
    x = F.regexp_replace(x, r"(?:^|/)(?:index|page)?\.(?:tsx|jsx)$|\.(?:tsx|jsx)$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\([^)]*\)/?", ""), r"\[\[?\.\.\.(\w+)\]?\]", ":$1*")
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(x, r"\[(\w+)\]", ":$1"), "/+$", ""))


def navigations(files: DataFrame) -> DataFrame:
    """(repository, path, line, framework, target, method)."""
    out = [_base(_hits(files, language, pattern), framework, F.regexp_extract("hit", pattern, group).alias("target"), F.lit(method).alias("method")) for framework, language, pattern, group, method in NAVIGATIONS]
    return reduce(DataFrame.unionByName, out)


def remote_objects(files: DataFrame) -> DataFrame:
    """(repository, path, line, framework, url): callers of object storage as ``scheme://bucket/key``."""
    out = [_base(_hits(files, language, pattern), framework, F.concat(F.lit(f"{scheme}://"), F.regexp_extract("hit", pattern, bucket), F.lit("/"), F.regexp_extract("hit", pattern, key)).alias("url")) for framework, language, pattern, scheme, bucket, key in OBJECTS]
    return reduce(DataFrame.unionByName, out)


def procedures(files: DataFrame) -> DataFrame:
    """(repository, path, line, framework, method, route): remote procedures as endpoints."""
    out = []
    for framework, language, pattern, service, method in RPC:
        h = _hits(files, language, pattern)
        a, b = F.regexp_extract("hit", pattern, service), F.regexp_extract("hit", pattern, method)
        if framework == "trpc":
            out.append(_base(h, framework, F.when(b == "query", "GET").otherwise("POST").alias("method"), normal_route(F.concat(F.lit("/trpc/"), a)).alias("route")))
        else:
            out.append(_base(h, framework, F.lit("GRPC").alias("method"), F.concat(F.lit("grpc:"), a, F.lit("/"), b).alias("route")))
    return reduce(DataFrame.unionByName, out)
