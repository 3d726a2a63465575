"""Column functions over paths and commit messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a path as a test or as vendored code, lower-cased.
TEST_PATHS = ["/test/", "/tests/", "^test/", "^tests/", "test_", r"_test\.", r"\.test\.", "/spec/", "^spec/", r"_spec\.", r"\.spec\."]
VENDOR_PATHS = ["/vendor/", "/node_modules/", "/static/", "/dist/", "/build/", "/generated/", r"\.min\.", "/third_party/", "/third-party/", "/extern/", "/deps/"]
#: The words that put a commit in a class.
COMMIT_WORDS = {
    "fix": ["fix", "bug", "patch", "hotfix", "resolve"],
    "revert": ["revert", "rollback", "undo"],
    "refactor": ["refactor", "cleanup", "restructure"],
    "feature": ["feat", "add ", "new ", "implement", "introduce"],
    "security": ["security", "vuln", "cve", "xss", "injection", "leak"],
    "performance": ["perf", "optim", "speed", "fast", "cache"],
    "test": ["test", "spec", "assert"],
    "docs": ["doc", "readme", "comment"],
}


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike("|".join(TEST_PATHS))


def is_vendor_path(path: Column) -> Column:
    return F.lower(path).rlike("|".join(VENDOR_PATHS))


def source_class(path: Column) -> Column:
    """source 0, test 1, vendor 2; vendor is looked at first."""
    return F.when(is_vendor_path(path), 2).when(is_test_path(path), 1).otherwise(0)


def commit_tags(message: Column) -> Column:
    """All classes whose words the first line holds, else [other]."""
    line = F.lower(F.split(message, "\n")[0])
    found = F.filter(F.array(*[F.when(line.rlike("|".join(words)), tag) for tag, words in COMMIT_WORDS.items()]), lambda t: t.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def commit_scope(message: Column) -> Column:
    """`type(scope):` gives scope: the first parentheses, a colon right after them; else null."""
    return F.nullif(F.regexp_extract(message, r"^[^(]*\(([^)]*)\):", 1), F.lit(""))


def co_authors(message: Column) -> Column:
    return F.regexp_extract_all(message, F.lit(r"(?m)^Co-[Aa]uthored-[Bb]y:\s*(.+?)\s*$"), F.lit(1))


def module_prefix(path: Column) -> Column:
    """The first two parts of a path of three parts or more, else the first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0])


def activity_module(path: Column) -> Column:
    """The first two parts, `root` for a file without a folder, empty for what is no path."""
    parts = F.split(path, "/")
    return F.when(path.contains("/"), F.concat_ws("/", parts[0], parts[1])).when(path.contains("."), "root").otherwise("")
