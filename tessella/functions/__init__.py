"""Column functions: built-in expressions where they suffice, Arrow functions elsewhere."""
