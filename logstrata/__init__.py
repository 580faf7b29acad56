"""logstrata: syslog parsing, storage and exploration as Spark jobs.

Every public function takes and returns DataFrames or Columns. Times are
``timestamp_ntz`` values in UTC; "now" is always an argument, so that a job
can be repeated and gives the same rows.
"""
