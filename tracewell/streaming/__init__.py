"""Job-event streams: each operator works on a batch DataFrame, the stateful ones on streams too."""
