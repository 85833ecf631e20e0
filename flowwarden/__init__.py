"""flowwarden: firewall-log behaviour analytics as plain Spark jobs.

Every operator is a function from DataFrame to DataFrame with its columns and
thresholds as arguments.  Column rules live in ``functions``, row and group
operators in ``operators``, readers and writers in ``sources``, multi-step jobs
in ``plans`` and the Structured Streaming jobs in ``streaming``.
"""
