"""flowquarry: behavioural analytics over network flows, DNS and events as Spark jobs."""
