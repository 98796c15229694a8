"""Repository evidence as composable DataFrame operators."""
