from . import audits, dossiers, engine, matching, scalars, text  # noqa: F401
