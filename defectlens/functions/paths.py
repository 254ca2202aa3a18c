"""Paths, identities and what can be read off a file name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Supported extensions and the language shown for each.
LANGUAGES = {
    ".py": "Python",
    ".js": "JavaScript",
    ".ts": "TypeScript",
    ".java": "Java",
    ".c": "C",
    ".cpp": "C++",
    ".h": "C/C++ Header",
    ".hpp": "C++ Header",
    ".cs": "C#",
    ".go": "Go",
    ".php": "PHP",
    ".rb": "Ruby",
    ".swift": "Swift",
    ".kt": "Kotlin",
    ".m": "Objective-C",
    ".mm": "Objective-C++",
}
UNNAMED = ["", "(anonymous)", "<anonymous>", "anonymous"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_path(c: Column | str) -> Column:
    """One spelling per path: forward slashes, no empty or ``.`` segments, no trailing slash."""
    given = col(c)
    path = F.regexp_replace(given, r"[\\/]+", "/")
    path = F.regexp_replace(path, r"(?:/\.)+(/|$)", "$1")
    path = F.regexp_replace(path, r"^(?:\./)+", "")
    path = F.regexp_replace(path, r"(.)/$", "$1")
    # One look tells that nearly all paths are in order already.
    return F.when(given.rlike(r"\\|//|(?:^|/)\.(?:/|$)|/$"), path).otherwise(given)


def file_id(repo: Column | str, path: Column | str) -> Column:
    return norm_path(F.concat(F.lit("data/repos/"), col(repo), F.lit("/"), col(path)))


def file_name(c: Column | str) -> Column:
    return F.regexp_extract(col(c), "[^/]*$", 0)


def repo_name(path: Column | str) -> Column:
    """The segment after the first ``repos`` segment, else the first segment, else the empty string."""
    whole = norm_path(path)
    parts = F.filter(F.split(whole, "/"), lambda part: part != "")
    marker = F.array_position(parts, "repos")
    after = F.when(marker > 0, F.try_element_at(parts, (marker + 1).cast("int")))
    first = F.when(whole.startswith("/"), F.lit("/")).otherwise(F.try_element_at(parts, F.lit(1)))
    return F.coalesce(after, first, F.lit(""))


def function_id(file: Column | str, function: Column | str, start_line: Column | str) -> Column:
    return F.concat_ws("::", col(file), col(function), col(start_line).cast("string"))


def extension(path: Column | str) -> Column:
    """Lower-cased, from the last dot of the base name; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(col(path), r"[^/](\.[^./]+)$", 1))


def is_supported(path: Column | str) -> Column:
    """One match on one mention of ``path``, because a pushed-down filter repeats what computes the path."""
    endings = "|".join(ext[1:] for ext in LANGUAGES)
    return col(path).rlike(rf"(?i)[^/]\.(?:{endings})$")


def is_python(path: Column | str) -> Column:
    return extension(path) == ".py"


def language(path: Column | str) -> Column:
    pairs = [F.lit(word) for pair in LANGUAGES.items() for word in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension(path)), F.lit("Unknown"))


def is_test_file(path: Column | str) -> Column:
    whole = F.lower(col(path))
    base = file_name(whole)
    return (base.contains("test") | base.contains("spec") | whole.contains("tests")).cast("int")


def clean_function_name(c: Column | str, style: str = "display") -> Column:
    """``display`` renames every unnamed function and trims; ``extract`` only fills in for a missing name."""
    name = col(c)
    if style == "extract":
        return F.when(name.isNull() | (name == ""), F.lit("anonymous_closure")).otherwise(name)
    text = F.trim(name)
    unnamed = name.isNull() | (name == "") | text.isin(*[n for n in UNNAMED if n])
    return F.when(unnamed, F.lit("anonymous closure")).otherwise(text)
