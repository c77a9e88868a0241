"""Rule packs and composed pipelines."""
