"""Writers and nested export documents."""
