"""Analytics for two-mode (bipartite) affiliation networks on PySpark.

From an enrolment table (student, course, major, grad, hours) the package
derives degrees and costs, merges equivalent students, removes hubs under cost
budgets and reports inclusion, connectivity and betweenness.
"""
