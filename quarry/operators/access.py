"""Request-log gating jobs (G3, G4): status per request, link stripping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import access as A
from quarry.operators.membership import Universe, known_keys


def request_status(requests: DataFrame, listing: DataFrame, require_auth: bool,
                   group_id: str | None, path_col: str = "path",
                   principal_id_col: str = "principal_id", header_col: str = "principal",
                   file_col: str = "filename") -> DataFrame:
    """401 / 403 / 404 / 200 for every request row.

    ``listing`` holds the export folder's file names (column ``filename``).
    Only requests that are let through to a file look at it, and of those only
    the ones whose name may be listed are joined to it
    (:mod:`quarry.operators.membership`).
    """
    r = requests.withColumn("groups", A.group_ids(header_col)) \
        .withColumn("can_download", A.can_download(F.col("groups"), require_auth, group_id))
    is_file = F.coalesce(F.col(path_col).startswith(A.FILES_PREFIX), F.lit(False))
    unauth = (F.lit(require_auth) & ~F.coalesce(F.col(path_col).isin(A.AUTH_EXEMPT_PATHS), F.lit(False))
              & (F.coalesce(F.col(principal_id_col), F.lit("")) == ""))
    status = (F.when(unauth, 401)
              .when(is_file & ~F.col("can_download"), 403)
              .when(is_file & A.unsafe_name(F.col(file_col)), 403)
              .when(~is_file, 200))
    asked = r.withColumn("status", status.cast("int")).withColumn(
        "__wanted", F.when(F.col("status").isNull(), F.col(file_col)))
    out = known_keys(asked, {"__wanted": "__listed"}, Universe(listing, "filename"))
    return out.withColumn("status", F.coalesce("status", F.when(F.coalesce("__listed", F.lit(False)), 200).otherwise(404)
                                               .cast("int"))).drop("__wanted", "__listed")


def strip_links(df: DataFrame, files_col: str, allowed_col: str = "can_download") -> DataFrame:
    """Callers outside the download group get no file links."""
    return df.withColumn(files_col, F.when(F.col(allowed_col), F.col(files_col))
                         .otherwise(F.array().cast(df.schema[files_col].dataType)))
