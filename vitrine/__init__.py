"""Website-evidence analytics as Spark DataFrame jobs.

Every function takes DataFrames and returns DataFrames keyed by ``(site, run_id)`` (or by the keys passed in), so one
job covers all sites and all runs at once.
"""
