"""Tables in and out: the session calendar, landed vendor pages, idempotent appends, sinks."""
