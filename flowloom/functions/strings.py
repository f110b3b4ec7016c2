"""Names of tables, environment variables and SQL statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: irregular plurals.
IRREGULAR = {
    "people": "person", "children": "child", "feet": "foot", "teeth": "tooth", "mice": "mouse",
    "men": "man", "women": "woman", "geese": "goose", "oxen": "ox", "data": "datum",
}


def singular(s: Column) -> Column:
    """The singular of a plural table name; null where no rule applies or the name is under four letters."""

    def drop(n: int) -> Column:
        return F.left(s, F.length(s) - n)

    out = F.when(F.length(s) < 4, F.lit(None).cast("string"))
    for plural, one in IRREGULAR.items():
        out = out.when(s == plural, one)
    return (
        out.when(s.endswith("ies"), F.concat(drop(3), F.lit("y")))
        .when(s.endswith("sses"), drop(2))
        .when(s.endswith("ses") & ~s.endswith("uses"), drop(1))
        .when(s.rlike("(?:x|z|ch|sh)es$"), drop(2))
        .when(s.endswith("s"), drop(1))
    )


def pascal(s: Column) -> Column:
    return F.concat(F.upper(F.left(s, F.lit(1))), F.substring(s, 2, 1 << 30))


def camel(s: Column) -> Column:
    return F.concat(F.lower(F.left(s, F.lit(1))), F.substring(s, 2, 1 << 30))


def snake_to_camel(s: Column) -> Column:
    """An underscore and the lower-case letter after it become the upper-case letter."""
    parts = F.split(s, "_", -1)

    def later(x: Column, i: Column) -> Column:
        return F.when(i == 0, x).when(x.rlike("^[a-z]"), pascal(x)).otherwise(F.concat(F.lit("_"), x))

    return F.array_join(F.transform(parts, later), "")


def table_aliases(s: Column) -> Column:
    """Every name that code may give a table: as it is, in Pascal and camel case, plural and singular."""

    def forms(x: Column) -> Column:
        c = snake_to_camel(x)
        return F.array(x, pascal(x), camel(x), c, pascal(c), camel(c))

    one = singular(s)
    both = F.concat(forms(s), F.when(one.isNotNull(), forms(one)).otherwise(F.array().cast("array<string>")))
    return F.filter(F.array_distinct(both), lambda x: x != "")


#: Fixed: prefixes of environment variables by category, the first that fits counts.
ENV_CATEGORIES = (
    ("database", "DATABASE DB MONGO MYSQL POSTGRES PG REDIS SQLITE CASSANDRA DYNAMO"),
    ("auth", "JWT AUTH OAUTH SESSION SECRET TOKEN PASSWORD CREDENTIALS API_KEY PRIVATE_KEY"),
    ("api", "API_ OPENAI STRIPE TWILIO SENDGRID FIREBASE AWS GCP AZURE WEBHOOK"),
    ("config", "PORT HOST NODE_ENV LOG DEBUG CORS RATE_LIMIT TIMEOUT BASE_URL APP_"),
)


def env_category(name: Column) -> Column:
    up, out = F.upper(name), F
    for category, prefixes in ENV_CATEGORIES:
        out = out.when(up.rlike(f"^(?:{prefixes.replace(' ', '|')})"), category)
    return out.otherwise("unknown")


#: The last part of a name of one or several parts, quoted or not.
_NAME = r"(?:[`\"\[]?[A-Za-z_][\w$]*[`\"\]]?\.)*+[`\"\[]?([A-Za-z_][\w$]*)[`\"\]]?"
#: Statements in the order in which they are looked for.
SQL_FORMS = (
    ("insert", rf"(?is)\binsert\s+(?:or\s+\w+\s+)?into\s+{_NAME}"),
    ("update", rf"(?is)\bupdate\s+(?:only\s+)?{_NAME}(?:\s+(?:as\s+)?\w+)?\s+set\b"),
    ("delete", rf"(?is)\bdelete\s+from\s+{_NAME}"),
    ("read", rf"(?is)\bselect\b.*?\bfrom\s+{_NAME}"),
)


def sql_table_op(sql: Column) -> Column:
    """struct(table, operation) of the first statement form found; comments don't count."""
    bare = F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")
    out = F.lit(None).cast("struct<table:string,operation:string>")
    for operation, pattern in reversed(SQL_FORMS):
        table = F.regexp_extract(bare, pattern, 1)
        out = F.when(table != "", F.struct(table.alias("table"), F.lit(operation).alias("operation"))).otherwise(out)
    return out


#: Fixed: names of vendored and minified bundles, by their end and in full.
VENDORED_NAME = r"(?i)(?:\.min|-min|-vendor|\.umd)\.(?:js|mjs)$"
KNOWN_BUNDLES = ("jquery.js", "jquery-ui.js", "moment.js", "moment-with-locales.js", "vue.global.js", "vue.runtime.global.js", "angular.js", "react.development.js", "react.production.min.js")


def looks_vendored(path: Column, size: Column, head: Column) -> Column:
    """By name; else for plain scripts by a known name of 50 KB or more, or by 100 KB or more with lines of over 200 in the first 4096 characters."""
    name = F.element_at(F.split(path, "/"), -1)
    start = F.substring(head, 1, 4096)
    breaks = F.length(start) - F.length(F.replace(start, F.lit("\n"), F.lit("")))
    long_lines = (F.length(start) > 0) & ((breaks == 0) | (F.length(start) > 200 * breaks))
    known = F.lower(name).isin(*KNOWN_BUNDLES) & (size >= 50 * 1024)
    return name.rlike(VENDORED_NAME) | (name.rlike(r"(?i)\.(?:js|mjs)$") & (known | ((size >= 100 * 1024) & long_lines)))
