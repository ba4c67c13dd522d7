"""Streaming: intentionally empty.

The reference has no stream processing (no watermark, window, state or late
data handling anywhere), and every estimator it uses - Kaplan-Meier risk
sets, log-rank sums, Cox partial likelihood, exact quantiles, concordance -
needs the complete cohort, so nothing here is re-expressed with Structured
Streaming. Batch jobs over a table that a stream appends to are the
supported pattern: rerun the query on the table.
"""
