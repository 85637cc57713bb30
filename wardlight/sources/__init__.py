"""Reading messages and labelled data; writing tables, feeds and documents."""
