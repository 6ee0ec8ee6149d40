"""Inventory onboarding: requested applications in, accepted or rejected rows out.

Rows are (name, repo_type, repo_url, local_path, team, owner, criticality,
auto_scan, position); `position` is the order of the request within its file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leakloom.functions import text as tx

REPO_TYPES = ("github", "gitlab", "bitbucket", "local")


def _kind() -> Column:
    return F.lower(F.coalesce(F.col("repo_type"), F.lit("")))


def url_host(url: Column) -> Column:
    """Authority part; empty when the text has no '//' authority."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def url_path_parts(url: Column) -> Column:
    path = F.regexp_extract(
        F.coalesce(url, F.lit("")),
        r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*?)(?:;[^/?#]*)?(?:[?#].*)?$", 1)
    return F.split(F.btrim(path, F.lit("/")), "/")


def parse_repo_url(requests: DataFrame) -> DataFrame:
    """Host, owner and repository of a URL, with the shape error if it has one."""
    url = F.col("repo_url")
    parts = url_path_parts(url)
    repo = F.try_element_at(parts, F.lit(2))
    return requests.select(
        "*",
        url_host(url).alias("host"),
        F.element_at(parts, 1).alias("repo_owner"),
        F.when(repo.endswith(".git"), F.left(repo, F.length(repo) - 4)).otherwise(repo).alias("repo_name"),
        _url_error().alias("url_error"),
    )


def _url_error() -> Column:
    host = url_host(F.col("repo_url"))
    return (
        F.when((_kind() == "github") & ~host.contains("github.com"), "Not a valid GitHub URL")
        .when((_kind() == "github") & (F.size(url_path_parts(F.col("repo_url"))) < 2),
              "Invalid GitHub repository path")
        .when((_kind() == "gitlab") & ~host.contains("gitlab"), "Not a valid GitLab URL")
    )


def _missing_field() -> Column:
    return (
        F.when(~tx.present(F.col("name")), "Application name is required")
        .when((_kind() == "local") & ~tx.present(F.col("local_path")),
              "Local path is required for local repositories")
        .when((_kind() != "local") & ~tx.present(F.col("repo_url")),
              "Repository URL is required for remote repositories")
    )


def _repository_error() -> Column:
    unsupported = F.when(
        ~_kind().isin(*REPO_TYPES),
        F.concat(F.lit("Unsupported repository type: "), F.coalesce(F.col("repo_type"), F.lit(""))))
    return F.concat(F.lit("Repository validation failed: "), F.coalesce(unsupported, _url_error()))


def validate(requests: DataFrame) -> DataFrame:
    """Requests with `field_error` and `repository_error`; both null when valid."""
    return requests.select("*", _missing_field().alias("field_error"),
                           _repository_error().alias("repository_error"))


def new_applications(requests: DataFrame, applications: DataFrame) -> DataFrame:
    """Requests whose name is not taken yet."""
    return requests.join(applications.select("name").distinct(), "name", "left_anti")


def _name_outcomes(requests: DataFrame) -> DataFrame:
    """Per name: first valid position and the last request, by plain aggregates."""
    checked = validate(requests.where(tx.present(F.col("name"))))
    valid = F.col("field_error").isNull() & F.col("repository_error").isNull()
    last = F.max_by(F.struct("field_error", "repository_error", "position"), F.col("position"))
    return checked.groupBy("name").agg(
        F.min(F.when(valid, F.col("position"))).alias("first_valid"),
        last.alias("last"),
    )


def bulk_result(requests: DataFrame, applications: DataFrame) -> DataFrame:
    """The message reported per name: that of its last request.

    Requests apply in order: the first valid one takes the name, a later one meets
    it, unless a missing field stops it before.
    """
    known = applications.select("name", F.lit(True).alias("known")).distinct()
    joined = _name_outcomes(requests).join(known, "name", "left")
    taken = F.coalesce("known", F.lit(False)) | (F.col("first_valid") < F.col("last.position"))
    exists = F.concat(F.lit("Application '"), F.col("name"), F.lit("' already exists"))
    error = (F.when(F.col("last.field_error").isNotNull(), F.col("last.field_error"))
             .when(F.coalesce(taken, F.lit(False)), exists)
             .otherwise(F.col("last.repository_error")))
    return joined.select(
        "name",
        F.when(error.isNull(), "Success").otherwise(F.concat(F.lit("Failed: "), error)).alias("result"),
    )


def accepted_applications(requests: DataFrame, applications: DataFrame, as_of: Column) -> DataFrame:
    """Rows to insert: the first valid request of every free name, with defaults."""
    checked = validate(requests.where(tx.present(F.col("name"))))
    valid = checked.where(F.col("field_error").isNull() & F.col("repository_error").isNull())
    columns = ("repo_type", "repo_url", "local_path", "team", "owner", "criticality", "auto_scan")
    first = valid.groupBy("name").agg(F.min_by(F.struct(*columns), F.col("position")).alias("row"))
    return new_applications(first, applications).select(
        "name", "row.repo_type", "row.repo_url", "row.local_path", "row.team", "row.owner",
        F.coalesce("row.criticality", F.lit("medium")).alias("criticality"),
        "row.auto_scan",
        F.lit("active").alias("status"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )
