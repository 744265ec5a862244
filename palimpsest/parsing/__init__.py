"""The document format in plain Python: one document's bytes in, its relations out. Nothing here knows Spark; plans/engine.py
runs it inside Arrow batches, as containers, anchors and inline state are sequential."""
