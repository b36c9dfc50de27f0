"""The operational surfaces that a change crosses: by its paths, by the words of its changed lines, by words that it takes away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of path components (directories or whole names) that tell a surface.
COMPONENTS = {
    "background_job": ("job", "jobs", "worker", "workers", "task", "tasks", "queue", "queues", "consumer", "consumers", "cron", "scheduler", "schedulers"),
    "deployment": ("k8s", "kubernetes", "deploy", "deployment", "helm", "chart", "charts", "terraform", "infra", "ansible"),
    "migration": ("migration", "migrations", "migrate", "alembic", "liquibase", "flyway"),
    "public_contract": ("api", "apis", "route", "routes", "endpoint", "endpoints", "interface", "interfaces", "contract", "contracts", "schema", "schemas", "proto"),
}
# Names that tell a surface as a directory, or as a file's name before its last suffix.
SUBJECTS = {
    "cache": ("cache", "caches", "caching"),
    "feature_flag": ("featureflag", "featureflags", "feature_flag", "feature_flags", "flag", "flags", "featuretoggle", "featuretoggles", "feature_toggle", "feature_toggles", "toggle", "toggles"),
}
# File names before their last suffix that are a contract, beginnings of a contract's description.
CONTRACT_STEMS = ("route", "routes", "api", "schema", "serializer", "serializers")
DESCRIPTIONS = ("openapi", "swagger")
# Words of added or removed lines that tell a surface.
WORDS = {
    "background_job": ("celery", "sidekiq", "resque", "bullmq", "kafka", "rabbitmq", "amqp", "sqs", "pubsub", "shared_task", "apply_async", "enqueue", "dequeue", "perform_later", "crontab", "cron_schedule"),
    "feature_flag": ("featureflag", "featureflags", "feature_flag", "feature_flags", "featuretoggle", "featuretoggles", "feature_toggle", "feature_toggles", "launchdarkly", "unleash", "flagsmith", "flipper", "flag_enabled", "is_feature_enabled"),
    "resource_limits": ("max_connections", "pool_size", "connection_pool", "max_pool_size", "replicas", "rate_limit", "rate_limits", "max_workers", "concurrency", "memory_limit", "cpu_limit", "batch_size", "semaphore"),
    "retry_timeout": ("retry", "retries", "retrying", "backoff", "timeout", "timeouts", "deadline", "max_attempts", "max_retries", "tenacity", "circuit_breaker"),
}
# The same, but an underscore ends such a word too.
PARTS = {"cache": ("cache", "caches", "cached", "caching", "invalidate", "invalidation", "memcache", "memcached", "redis", "memoize", "memoized", "ttl")}
# Words whose removal tells a surface, if the same hunk adds a line.
REMOVED = {"observability": ("logger", "logging", "log_", "metric", "metrics", "prometheus", "statsd", "datadog", "opentelemetry", "otel", "tracer", "tracing", "start_span", "start_as_current_span", "sentry", "alert", "alerts")}


def _any_of(found: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(found, F.array(*[F.lit(n) for n in names]))


def path_surfaces(path: Column) -> Column:
    """The sorted surfaces that a path tells, whatever its case."""
    low = F.lower(path)
    parts = F.split(low, "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    # The name before its last suffix, where there is one.
    stem = F.when(name.rlike(r"\.[^.]+\z"), F.regexp_replace(name, r"\.[^.]+\z", ""))
    first = F.when(name.rlike(r"\A[^.]+\.."), F.substring_index(name, ".", 1))
    told = {surface: _any_of(parts, names) for surface, names in COMPONENTS.items()}
    told["migration"] = told["migration"] | (name.endswith(".sql") & (F.contains(name, F.lit("migrat")) | F.contains(F.regexp_replace(name, r"\.sql\z", ""), F.lit("schema"))))
    compose = first.isin("compose", "values") & name.rlike(r"\A[^.]+(?:\.[^.]+)?\.ya?ml\z")
    workflow = F.array_contains(F.zip_with(F.slice(parts, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts) - 1), lambda a, b: (a == ".github") & (b == "workflows")), True) & (name != "workflows")
    told["deployment"] = told["deployment"] | name.startswith("dockerfile") | F.coalesce(compose, F.lit(False)) | name.endswith(".tf") | name.endswith(".tfvars") | workflow
    described = (name.startswith(DESCRIPTIONS[0]) | name.startswith(DESCRIPTIONS[1])) & name.rlike(r"\.(?:ya?ml|json)\z")
    told["public_contract"] = told["public_contract"] | described | F.coalesce(F.regexp_replace(name, r"(?s)\.[^/]+\z", "").isin(*CONTRACT_STEMS) & name.contains("."), F.lit(False)) | F.coalesce(first.isin(*CONTRACT_STEMS), F.lit(False)) | name.endswith(".proto")
    for surface, names in SUBJECTS.items():
        told[surface] = _any_of(folders, names) | F.coalesce(first.isin(*names), F.lit(False)) | F.coalesce(stem.isin(*names), F.lit(False))
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(surface)) for surface, hit in told.items()])))


def surfaces(files: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """(key, surface): the distinct surfaces of each change, from `files` (key, path) and diff_lines() (key, block, hunk, mark, line).

    A word counts in added and removed lines, never in context. One whose loss matters counts only where its own hunk adds a
    line that a finding could point at. Hunks are gathered first, so that a line is read once and a change of any number of lines
    meets as one row for each hunk. A change that tells none has no rows.
    """
    marker = F.substring("line", 1, 1)
    body = lines.where(F.col("mark").isin("+", "-") & ~F.col("line").startswith("+++") & ~F.col("line").startswith("---"))
    text = F.lower(F.expr("substring(line, 2)"))
    words = body.select(key, "block", "hunk", (marker == "+").alias("adds"), F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), F.lit(1))).alias("w"), F.array_distinct(F.regexp_extract_all(text, F.lit("([0-9a-z]+)"), F.lit(1))).alias("p"))
    told = {s: F.bool_or(_any_of(F.col("w"), n)) for s, n in WORDS.items()} | {s: F.bool_or(_any_of(F.col("p"), n)) for s, n in PARTS.items()}
    lost = {s: F.bool_or(_any_of(F.col("w"), n) & ~F.col("adds")) & F.bool_or("adds") for s, n in REMOVED.items()}
    hunks = words.groupBy(key, "block", "hunk").agg(*[hit.alias(s) for s, hit in (told | lost).items()])
    by_line = hunks.select(key, F.explode(F.array_compact(F.array(*[F.when(F.col(s), F.lit(s)) for s in [*told, *lost]]))).alias("surface"))
    by_path = files.select(key, F.explode(path_surfaces(F.col("path"))).alias("surface"))
    return by_path.unionByName(by_line).distinct()
