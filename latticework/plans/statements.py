"""Queries written in SQL alone, over the views and table functions of latticework.sql; each gives the rows of a DataFrame query."""

from __future__ import annotations

from latticework import sql
from latticework.plans import graphs, subjects

#: Each statement, and the query whose rows it gives.
STATEMENTS = {
    "sql_clustering": (
        """SELECT label, node, degree, round(clustering, 9) AS clustering
        FROM graph_nodes(TABLE(SELECT label, i, j, w FROM connectivity) PARTITION BY (label), 0.3D)""",
        graphs.ORACLE["clustering_coef"],
    ),
    "sql_efficiency": (
        """SELECT label, round(efficiency, 9) AS efficiency
        FROM graph_summary(TABLE(SELECT label, i, j, w FROM connectivity) PARTITION BY (label), 0.1D)""",
        graphs.ORACLE["global_efficiency"],
    ),
    "sql_phase_connectivity": (
        """WITH waves AS (
          SELECT subject, epoch, channel, map_from_entries(collect_list(struct(sample, value))) AS wave
          FROM recordings GROUP BY subject, epoch, channel),
        epochs AS (SELECT subject, map_from_entries(collect_list(struct(channel, wave))) AS waves FROM waves GROUP BY subject, epoch)
        SELECT subject, ch_i, ch_j, freq, round(w, 9) AS w
        FROM phase_connectivity(TABLE(SELECT subject, waves FROM epochs) PARTITION BY (subject), 24.0D, 24, 2.0D, 1.0D, 11.0D)""",
        subjects.ORACLE["multitaper_wpli"],
    ),
}


def stated(text: str):
    def run(spark, sf_dir):
        sql.register(spark, sf_dir)
        return spark.sql(text)

    return run


QUERIES = {name: stated(text) for name, (text, _) in STATEMENTS.items()}
ORACLE = {name: same for name, (_, same) in STATEMENTS.items()}
