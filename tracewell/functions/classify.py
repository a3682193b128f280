"""Predicates and classifiers over tool names, commands, outputs, messages, paths and remotes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regex import re2

#: Patterns of commands, outputs and messages.
VERIFY_COMMAND = r"(?i)(go test|go build|go vet|gotestsum|pytest|py\.test|npm (run )?(test|build)|yarn (test|build)|pnpm (test|build)|jest|vitest|mocha|cargo (test|build|clippy)|make( |$)|tsc(\s|$)|eslint|ruff|flake8|mypy|golangci-lint|rubocop|phpunit|gradle (test|build)|mvn (test|verify)|dotnet test|ctest)"
LAND_COMMAND = r"(?i)(git commit|git push|gh pr create)"
NON_ZERO_EXIT = r"(?i)(exit status|exit code|exited with code) [1-9]"
ZERO_EXIT = r"(?i)(exit status|exit code|exited with code) 0"
FAILURE_SIGNAL = r"(?im)(^|\n)FAIL(\s|$)|(^|\n)FAILED(\s|$)|[1-9][0-9]*\s+(failed|failures?|failing)|Traceback|panic:|\berror:"
DIFF_HUNK = r"(?m)^@@ "
CORRECTION = r"(?i)\b(wrong|try again|fix|failed|failing|error|broken|revert|undo|not what|doesn'?t|didn'?t|actually)\b"
ACCEPTANCE = r"(?i)\b(lgtm|looks good|works|thank|thanks|great|perfect|ship it|nice|done)\b"
EDIT_BY_SHELL = r"(?i)\b(apply_patch|str_replace|cat >|tee .*>|python .*write_text|go fmt|gofmt -w|prettier --write)\b"
SKILL_INJECTION = r"(?i)base directory for this skill:\s*[^\r\n]*[\\/]skills[\\/]([A-Za-z0-9._-]+)\b"
INTERRUPTION = r"(?i)\[request interrupted by user"
#: Tool names.
EDIT_TOOLS = ["edit", "write", "multiedit", "str_replace", "str_replace_editor", "apply_patch", "create_file"]
EXEC_TOOLS = ["bash", "shell", "sh", "zsh", "powershell", "exec", "exec_command", "run_command", "command"]
WEB_TOOL_PARTS = ["webfetch", "websearch", "web_search", "browser"]
#: Files by role, public hosts, permissive licences.
LOCKFILES = ["go.sum", "cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock", "composer.lock", "gemfile.lock"]
CONFIG_FILES = ["go.mod", "package.json", "tsconfig.json", "vite.config.ts", "webpack.config.js", "makefile", "dockerfile", "docker-compose.yml", "docker-compose.yaml", ".golangci.yml", ".golangci.yaml", ".gitignore"]
PUBLIC_HOSTS = ["github.com", "gitlab.com", "codeberg.org"]
PERMISSIVE = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "ISC", "Unlicense", "0BSD"]
#: Words of instruction prompts and of permanent failures.
INSTRUCTION_STARTS = ["<environment_context", "<user_instructions", "<environment_details", "<instructions", "<system-reminder", "# agents.md", "agents.md"]
INSTRUCTION_PARTS = ["agents.md instructions", "base directory for this skill", "claude.md instructions", "you are claude"]


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def is_web_tool(name: Column) -> Column:
    return any_of([F.lower(name).contains(p) for p in WEB_TOOL_PARTS])


def is_edit_tool(name: Column) -> Column:
    return F.lower(name).isin(EDIT_TOOLS)


def is_exec_tool(name: Column) -> Column:
    n = F.lower(F.btrim(name))
    return n.isin(EXEC_TOOLS) | n.endswith(".exec_command") | n.endswith(".run_command")


def output_failed(text: Column) -> Column:
    """A non-zero exit code fails, else a zero one doesn't, else a sign of failure does."""
    return F.when(text.rlike(re2(NON_ZERO_EXIT)), True).when(text.rlike(re2(ZERO_EXIT)), False).otherwise(text.rlike(re2(FAILURE_SIGNAL)))


def reaction(text: Column) -> Column:
    """'correction', else 'acceptance', else null."""
    return F.when(text.rlike(re2(CORRECTION)), "correction").when(text.rlike(re2(ACCEPTANCE)), "acceptance")


def skill_name(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, re2(SKILL_INJECTION), 1), F.lit(""))


def looks_like_instructions(text: Column) -> Column:
    low = F.lower(F.btrim(text))
    return any_of([low.startswith(p) for p in INSTRUCTION_STARTS] + [low.contains(p) for p in INSTRUCTION_PARTS])


def plain_path(path: Column) -> Column:
    """Without backslashes and empty, '.' and '..' parts, so that neither folding nor counting parts is needed; most paths are plain."""
    return ~path.rlike(r"\\|(^|/)\.{0,2}(/|$)")


def unsafe_path(path: Column) -> Column:
    """Empty, absolute, climbing out of its root, or with a zero byte."""
    p = F.regexp_replace(path, r"\\", "/")
    depth = F.aggregate(
        F.split(p, "/"),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("least")),
        lambda acc, part: F.struct(
            (acc["d"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)).alias("d"),
            F.least(acc["least"], acc["d"] + F.when(part == "..", -1).otherwise(0)).alias("least"),
        ),
    )
    zero = path.contains("\0")
    return F.when(plain_path(path), zero).otherwise((path == "") | path.startswith("/") | zero | (depth["least"] < 0) | (depth["d"] <= 0))


def clean_path(path: Column) -> Column:
    """Slashes forward, and empty, '.' and 'name/..' parts gone."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: ~x.isin("", "."))
    folded = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.when(plain_path(path), path).otherwise(F.array_join(folded, "/"))


def file_role(path: Column) -> Column:
    def role(low: Column) -> Column:
        base = F.substring_index(low, "/", -1)
        config = base.isin(CONFIG_FILES) | base.rlike(r"\.(toml|yaml|yml)$") | low.startswith(".github/") | low.startswith(".circleci/")
        test = low.rlike(r"(^|/)(test|tests|spec)/") | base.rlike(r"_test\.|\.test\.|_spec\.|\.spec\.") | base.startswith("test_")
        return F.when(base.isin(LOCKFILES), "lockfile").when(config, "config").when(test, "test").otherwise("solution")

    # One element of an array, as a cleaned path that is named so often would be worked out each time.
    cleaned = F.transform(F.array(F.lower(clean_path(path))), role)
    return F.when(unsafe_path(path), "unknown").otherwise(F.element_at(cleaned, 1))


def remote_host(remote: Column) -> Column:
    rest = F.substring_index(F.regexp_replace(remote, r"^.*?://", ""), "/", 1)
    with_scheme = F.substring_index(F.substring_index(rest, "@", -1), ":", 1)
    bare = F.regexp_extract(F.substring_index(remote, "@", -1), r"^[^:/]*", 0)
    return F.when(remote.contains("://"), with_scheme).otherwise(bare)


def is_public_remote(remote: Column) -> Column:
    low = F.lower(F.btrim(remote))
    closed = low.contains("private") | low.contains("enterprise") | low.contains("corp")
    return F.coalesce((low != "") & ~closed & remote_host(low).isin(PUBLIC_HOSTS), F.lit(False))


def public_repo_name(remote: Column) -> Column:
    r = F.regexp_replace(F.btrim(remote), r"\.git$", "")
    out = r
    for host in reversed(PUBLIC_HOSTS):
        at = F.instr(r, host + "/")
        out = F.when(at > 0, F.substring(r, at + len(host) + 1, F.length(r))).otherwise(out)
    return F.when(r.startswith("git@") & r.contains(":"), F.regexp_replace(r, r"^[^:]*:", "")).otherwise(out)


def licence(text: Column) -> Column:
    """SPDX id by the first rule that holds of a licence file's text; '' if none does."""
    low = F.lower(text)
    has = lambda *parts: reduce(lambda a, b: a & b, [low.contains(p) for p in parts])
    return (
        F.when(has("apache license", "version 2.0"), "Apache-2.0").when(has("mit license"), "MIT").when(has("bsd 2-clause"), "BSD-2-Clause")
        .when(has("bsd 3-clause"), "BSD-3-Clause").when(has("isc license"), "ISC").when(has("the unlicense"), "Unlicense").when(has("0bsd"), "0BSD")
        .when(has("gnu general public license", "affero"), "AGPL-3.0").when(has("gnu general public license"), "GPL-3.0").when(has("mozilla public license"), "MPL-2.0").otherwise("")
    )


#: Names of licence files in order, of lockfiles whose hashes are kept, and signs of context outside the repository.
LICENCE_FILES = ["LICENSE", "LICENSE.txt", "LICENSE.md", "COPYING"]
HASHED_LOCKFILES = ["go.sum", "go.mod", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "requirements.txt"]
OUTSIDE_PARTS = ["http://", "https://", "see attached", "screenshot"]


def repository_licence(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, spdx) of repositories' files (keys, name, content): by the first licence file that tells one."""
    place = F.array_position(F.array(*map(F.lit, LICENCE_FILES)), F.col("name"))
    told = files.where(F.col("name").isin(LICENCE_FILES)).withColumn("spdx", licence(F.col("content")))
    return told.groupBy(*keys).agg(F.coalesce(F.min_by("spdx", F.when(F.col("spdx") != "", place)), F.lit("")).alias("spdx"))


def needs_outside_context(prompts: Column) -> Column:
    """Whether any prompt points to something outside the repository."""
    return F.exists(prompts, lambda p: any_of([F.lower(p).contains(part) for part in OUTSIDE_PARTS]))


def raw_code_allowed(remote: Column, base_commit: Column, is_public: Column) -> Column:
    return (F.coalesce(remote, F.lit("")) != "") & (F.coalesce(base_commit, F.lit("")) != "") & F.coalesce(is_public, F.lit(False))


def is_main_transcript(path: Column, root: str, slug: Column) -> Column:
    """Whether a file lies right in its project's folder; those of subagents lie deeper."""
    return (F.coalesce(slug, F.lit("")) != "") & (F.regexp_replace(path, r"/[^/]*$", "") == F.concat(F.lit(root.rstrip("/") + "/projects/"), slug))


def permits_redistribution(spdx: Column) -> Column:
    return F.coalesce(spdx.isin(PERMISSIVE), F.lit(False))


def reproducibility_problems(t: dict[str, Column]) -> Column:
    """Reasons for which others can't reproduce a task, in order; none for a valid one.  Their texts are fixed values.

    t has remote, is_public, base_commit, prompts (a count), has_patch, base_from_start and files_touched.
    """
    no_patch = ~t["has_patch"]
    return F.array_compact(F.array(
        F.when(t["remote"] == "", "no git remote (origin) — nothing to clone"),
        F.when(~t["is_public"], "remote is not a recognized public host (github.com / gitlab.com / codeberg.org)"),
        F.when(t["base_commit"] == "", "no base commit — the starting state is unknown"),
        F.when(t["prompts"] == 0, "no developer prompt — there is no task statement"),
        F.when(no_patch & ~t["base_from_start"], "no code patch and base commit was not inferred from the transcript start"),
        F.when(no_patch & (t["files_touched"] == 0), "no code patch and no transcript edit evidence"),
    ))
